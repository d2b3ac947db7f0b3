"""Secret and PII spans against plain regular-expression searches, and round trips through nested layers."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import urllib.parse
import zlib

import pytest

from seekspark.llm import personal, secrets, spans

DDL = "doc_id long, text string, spans string, `Text_` string"


def brute(text, patterns):
    out = []
    for kind, pattern, right in patterns:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if right(m)]
    return out


def _digits(m):
    return re.sub("[^0-9]", "", m.group())


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


SECRET_PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 32),
]
PII_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
]


def test_base_secrets_equal_a_plain_search():
    rng = random.Random(1)
    bits = ["password", "Secret", "api_key", "APIKEY", "toKen", "=", ":", " ", "'", '"', "abcdefgh", "x", "AKIA", "ABCDEF123456", "Z9", "é", "\n",
            "0123456789abcdef", "ff", "/", "-", "%41", "\\u0041", "ſecret=abcdefghi"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = [x[:3] for x in secrets.find_secrets(text) if x[3]]
        assert sorted(got) == sorted(brute(text, SECRET_PATTERNS)), text


def test_base_personal_data_equals_a_plain_search():
    rng = random.Random(2)
    bits = ["@", "a", "b.c", ".", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "5500-0000-0000-0004", " ", "(", ")", "x@y.z", "é", "1.2.3.4",
            "+49 30 1234567", "https://", "iban DE89370400440532013000", "٣"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = [x[:3] for x in personal.find_personal(text) if x[3]]
        assert sorted(got) == sorted(brute(text, PII_PATTERNS)), text


def _url(s):
    return "".join(f"%{b:02X}" for b in s.encode())


def _b64(s):
    return base64.b64encode(s.encode()).decode()


SECRET = "password=hunter2hunter2"
WRAPS = {
    "url": _url, "url_twice": lambda s: _url(_url(s)), "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "hexescape": lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    "entity": lambda s: "".join(f"&#{ord(c)};" for c in s), "base64": _b64, "base64_twice": lambda s: _b64(_b64(s)), "base64_of_url": lambda s: _b64(_url(s)),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), "bz2": lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    "gzip_gzip": lambda s: base64.b64encode(gzip.compress(gzip.compress(s.encode()))).decode(),
    "quoted": lambda s: urllib.parse.quote(_b64(s), safe=""), "base64_unpadded": lambda s: _b64("x" + s).rstrip("="),
}


@pytest.mark.parametrize("wrap", WRAPS)
def test_a_wrapped_secret_is_found_at_its_place(wrap):
    inner = WRAPS[wrap](SECRET)
    text = f"Clean words before. {inner} and after."
    added = [x for x in secrets.find_secrets(text) if not x[3]]
    begin = text.index(inner)
    assert any(k == "assign" and begin <= s < e <= begin + len(inner) and e - s >= len(inner) * 0.5 for k, s, e, _ in added), added


def test_url_span_covers_only_the_escaped_characters():
    text = "ä pass%77ord=abcdefgh12 z"
    assert secrets.find_secrets(text) == [("assign", 2, 2 + len("pass%77ord=abcdefgh12"), False)]


def test_a_bomb_is_scanned_in_pieces():
    blob = base64.b64encode(gzip.compress(b"a " * (9 << 20) + SECRET.encode())).decode()
    assert ("assign", 0, len(blob), False) in secrets.find_secrets(blob)


def test_layers_that_repeat_end():
    layer = "%2525" * 50
    assert secrets.find_secrets(layer) == []


def test_long_words_are_no_layers():
    assert secrets.find_secrets("Donaudampfschifffahrtsgesellschaftskapitaen " * 20 + "abcdefghijklmnopqrstuvwxyz") == []


@pytest.mark.parametrize("odd", ["\u00a0", "\u202f", "\ufeff", "\u200b", "\u3000", "\x1b", "\0", "\udcff"])
def test_base64_that_is_not_all_printable_is_scanned(odd):
    raw = f"mot de passe{odd}: {SECRET} {odd}".encode("utf-8", "surrogateescape")
    blob = base64.b64encode(raw).decode()
    found = [x[:3] for x in secrets.find_secrets("see " + blob + " end")]
    at = raw.index(SECRET.encode())
    assert ("assign", 4 + at * 8 // 6, 4 - (-(at + len(SECRET)) * 8 // 6), ) in found


@pytest.mark.parametrize("coding", ["utf-16", "utf-16-le", "utf-16-be"])
def test_base64_of_utf16_is_scanned(coding):
    for text in (SECRET, "é " + SECRET + " fin"):
        found = secrets.find_secrets(base64.b64encode(text.encode(coding)).decode())
        assert [x[0] for x in found] == ["assign"]
        assert "assign" in [x[0] for x in secrets.find_secrets(base64.b64encode(gzip.compress(text.encode(coding))).decode())]


@pytest.mark.parametrize("short", ["token=abcdefgh", "secret=12345678", "passwd=12345678", "apikey=12345678"])
def test_the_shortest_assignments_are_decoded(short):
    for blob in (_b64(short), _b64(short).rstrip("=")):
        assert secrets.find_secrets(f"a {blob} b") == [("assign", 2, 2 + len(blob), False)]


def _noise(n):
    return "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz ", k=n))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\\n"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_base64_over_line_ends(end, pack):
    raw = pack((_noise(200) + " " + SECRET + " " + _noise(200)).encode())
    lines = re.findall(".{1,76}", base64.b64encode(raw).decode())
    text = f"-----BEGIN X-----{end}" + end.join(lines) + f"{end}-----END X-----"
    assert "assign" in [x[0] for x in secrets.find_secrets(text)]
    if pack is bytes:
        (_, start, stop, _), = secrets.find_secrets(text)
        at = raw.index(SECRET.encode())
        assert text[start:stop].replace(end, "") == base64.b64encode(raw).decode()[at * 8 // 6:-(-(at + len(SECRET)) * 8 // 6)]


@pytest.mark.parametrize("glue", ["com/cb/{}", "id_{}", "{}-suffix", "xy{}z", "a/{}/b_c"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_base64_glued_to_other_characters(glue, pack):
    blob = base64.b64encode(pack((SECRET + " ").encode())).decode().rstrip("=")
    assert "assign" in [x[0] for x in secrets.find_secrets("at " + glue.format(blob) + " end")]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_compressed_bytes_behind_escapes(pack):
    raw = pack((_noise(50) + SECRET).encode())
    for blob in ("".join(f"%{b:02X}" for b in raw), urllib.parse.quote_plus(raw), "".join(f"\\x{b:02x}" for b in raw), "".join(f"\\u{b:04x}" for b in raw), repr(raw)[2:-1]):
        text = f"a = b'{blob}' + other"
        assert ("assign", 6, 6 + len(blob), False) in secrets.find_secrets(text) or blob == urllib.parse.quote_plus(raw)
        assert [x[0] for x in secrets.find_secrets(text)] == ["assign"]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_every_member_is_unpacked_and_what_precedes_damage(pack):
    def b64(raw):
        return base64.b64encode(raw).decode()

    assert secrets.find_secrets(b64(pack(b"first") + pack(SECRET.encode())))
    assert secrets.find_secrets(b64(pack(pack(b"first") + pack(b"pass") + pack(SECRET[4:].encode()))))
    assert secrets.find_secrets(b64(pack(pack(b"first") + SECRET.encode())))
    if pack is not bz2.compress:  # its blocks come whole
        whole = pack((SECRET + " " + _noise(3000)).encode())
        assert secrets.find_secrets(b64(whole[:len(whole) // 2]))
        assert secrets.find_secrets(b64(whole[:len(whole) // 2] + b"\xff" * 40))
    assert secrets.find_secrets(b64(pack((SECRET + " ").encode())[:-2] + b"??"))


def test_a_stream_in_a_stream_is_read_over_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 512)
    inner = bytes(random.Random(1).choices(range(256), k=20000))
    raw = gzip.compress(gzip.compress(base64.b16encode(inner) + b" " + SECRET.encode()))
    assert "assign" in [x[0] for x in secrets.find_secrets(base64.b64encode(raw).decode())]


def test_added_personal_kinds():
    kinds = {k for k, *_ in personal.find_personal(
        "see https://me:pw@host.example/x IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678, SSN 123-45-6789")}
    assert {"url", "iban", "account", "ssn"} <= kinds
    assert personal.find_personal("an account of things, IBAN DE00370400440532013000") == []


def test_rows_and_digests(spark):
    rows = [(1, "secret: abcdefgh " + "AKIA" + "A" * 16, None, "x"), (2, None, "y", None), (2, None, None, None), (None, "", None, None)]
    frame = spark.createDataFrame(rows, DDL)
    out = {r["doc_id"]: r for r in spans.digest(secrets.scan(frame, ["doc_id"]), list(secrets.KINDS)).collect()}
    assert out[1]["spans"] == "assign:0:16,access:17:37" and out[1]["n_assign"] == out[1]["n_access"] == 1 and out[1]["n_hex"] == 0
    assert out[1]["base_sha256"] == hashlib.sha256(b"assign:0:16,access:17:37").hexdigest()
    assert out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[None]["spans"] == ""
    assert spans.digest(personal.scan(frame, ["doc_id"]), list(personal.BASE_KINDS)).count() == 4
    empty = spark.createDataFrame([], DDL)
    assert spans.digest(personal.scan(empty, ["doc_id"]), list(personal.BASE_KINDS)).count() == 0


def test_masking(spark):
    text = "a secret=abcdefgh1 b " + _b64(SECRET) + " c"
    frame = spark.createDataFrame([(1, text, 5), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.mask(frame, ["doc_id", "text", "n_chars"]).collect()}
    assert got[1]["text"] == "a [SECRET] b [SECRET] c" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean" and got[2]["n_chars"] == 5 and got[3]["text"] is None


def test_time_grows_with_the_text_not_with_its_square():
    lines = [f"key {_b64(f'password=hunter{i:09d}')} end" for i in range(20_000)]
    start = time.perf_counter()
    found = secrets.find_secrets("\n".join(lines))
    assert sum(not base for *_, base in found) >= 20_000
    assert time.perf_counter() - start < 20
    many = "token=abcdefgh1 x\n" * 20_000
    start = time.perf_counter()
    assert secrets.masked(many, "[SECRET]") == "[SECRET] x\n" * 20_000
    assert time.perf_counter() - start < 10


def test_masking_of_overlapping_and_adjacent_spans(monkeypatch):
    monkeypatch.setattr(secrets, "find_secrets", lambda text: [("hex", 1, 4, True), ("assign", 2, 6, True), ("hex", 6, 8, True), ("hex", 1, 2, False)])
    assert secrets.masked("0123456789", "#") == "0##89"
