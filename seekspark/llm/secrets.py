"""Secret scan: a worklist unwraps URL, Unicode, base64 and compressed layers until nothing new comes, scanning each.

A layer is a text whose characters know the span of the document they were made of, so a secret found three layers down
still has a place in the document. Layers seen before (by digest and place) are not unwrapped again, which ends cycles.

Base64 is decoded whatever it holds; what comes out is a layer if it has a match or a further layer in it, as text with any
bad bytes or as UTF-16.

Runs of base64 are decoded line by line and joined over line ends, from each of four digits on, so that what they are glued
to does not matter. Compressed streams are looked for anywhere in decoded bytes and in bytes written with URL, \\x or \\u
escapes; streams that follow each other or lie in each other are read on, and all that comes before damage is kept.

Defined cases: null text is empty; repeated rows are scanned each on its own; extra columns are not read; texts are scanned
whole. Compressed data is inflated in pieces of PIECE bytes that overlap by OVERLAP, so a bomb costs time, not memory; a
secret or an encoded layer longer than the overlap may be cut where two pieces meet. Streams lie in each other to at most
DEEPEST levels, which ends files that hold themselves.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seekspark.llm.common import slices, small_batches
from seekspark.llm.spans import Found, with_spans

KINDS = ("assign", "access", "hex")
PIECE = 8 << 20
OVERLAP = 64 << 10
FED, STEP, FINE, DEEPEST = 64 << 10, 1 << 20, 64, 100
# The patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of hex digits is taken whole, so the bound on its length can stand here
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

ESCAPED_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
UNICODE_UNIT = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
# The shortest secret, token= and eight more, takes 14 bytes: 19 base64 digits.
SHORTEST = 19
ENCODED = re.compile(r"([A-Za-z0-9+/_-]{19,})={0,2}")
LINE_END = re.compile(r"[ \t]*+(?:(?:\\r)?\\n|\r\n?|\n)[ \t]*+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]++(?:{LINE_END.pattern}[A-Za-z0-9+/_-]++)+)={{0,2}}")
# gzip, zlib, bzip2 and xz.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
URL_RUN = re.compile(r"[!#-;=?-~]+")
URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|.")
SOURCE_RUN = re.compile(r"[^\n]+")
SOURCE_BYTE = re.compile(r"""\\(?:x|u00)([0-9A-Fa-f]{2})|\\u\{0*([0-9A-Fa-f]{1,2})\}|\\([abfnrtv0'"\\])|[\0-\xff]""")
# What is there, escaped or not, if MAGIC is.
ESCAPED_MAGIC = re.compile(r"(?:%|\\x|\\u00|\\u\{0*)(?:1f|78|01|5e|9c|da|42|5a|68|fd)|BZh|x\^", re.I)
PLAIN_ESCAPES = dict(zip("abfnrtv0'\"\\", b"\x07\x08\x0c\n\r\t\x0b\0'\"\\", strict=True))


@dataclass
class Layer:
    """starts and ends: for each character the document span behind it; None in the document itself."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def starts_of(self, at: np.ndarray) -> np.ndarray:
        return at if self.starts is None else self.starts[at]

    def ends_of(self, at: np.ndarray) -> np.ndarray:
        return at + 1 if self.ends is None else self.ends[at]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            own = np.arange(len(self.text), dtype=np.int64)
            return own, own + 1
        return self.starts, self.ends


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Base matches of all kinds in one text: leftmost, not overlapping within a kind, failing ones dropped."""
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of escapes decoded; characters of a run share its places evenly. None if nothing changes."""
    pieces, starts, ends, at = [], [], [], 0
    own_starts, own_ends = None, None
    for m in pattern.finditer(layer.text):
        decoded = decode(m.group())
        if decoded is None:
            continue
        if own_starts is None:
            own_starts, own_ends = layer.arrays()
        plain, places = decoded
        pieces += [layer.text[at:m.start()], plain]
        starts += [own_starts[at:m.start()], own_starts[m.start() + np.array([p for p, _ in places], dtype=np.int64)]]
        ends += [own_ends[at:m.start()], own_ends[m.start() + np.array([q for _, q in places], dtype=np.int64) - 1]]
        at = m.end()
    if own_starts is None:
        return None
    pieces.append(layer.text[at:])
    starts.append(own_starts[at:])
    ends.append(own_ends[at:])
    return Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends))


def _from_url(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        plain = raw.decode("utf-8")
    except UnicodeDecodeError:
        plain = raw.decode("latin-1")
        return plain, [(3 * i, 3 * i + 3) for i in range(len(plain))]
    places, at = [], 0
    for c in plain:
        n = 3 * len(c.encode("utf-8"))
        places.append((at, at + n))
        at += n
    return plain, places


def _from_unicode(run: str):
    if run.startswith("&"):
        plain = html.unescape(run)
        return (plain, [(0, len(run))] * len(plain)) if plain != run else None
    units = [(m, int(m[1] or m[2] or m[3], 16)) for m in UNICODE_UNIT.finditer(run)]
    plain, places, held = [], [], None
    for m, code in units:
        if held is not None and 0xDC00 <= code < 0xE000:
            plain[-1], places[-1] = chr(0x10000 + ((held - 0xD800) << 10) + code - 0xDC00), (places[-1][0], m.end())
            held = None
            continue
        held = code if 0xD800 <= code < 0xDC00 else None
        plain.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
        places.append((m.start(), m.end()))
    return "".join(plain), places


def _opened(head: bytes):
    """A fresh unpacker for data that begins so; None if it is no known compressed format."""
    if not MAGIC.match(head):
        return None
    if head[:1] in (b"\x1f", b"x"):
        return zlib.decompressobj(31 if head[:1] == b"\x1f" else 15)
    return bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor(memlimit=256 << 20)


def _steps(unpacker, data: bytes, rest: list[bytes]) -> Iterator[bytes]:
    """What the unpacker makes of the data, all that comes before an error included; rest gets what lies behind its end."""
    if hasattr(unpacker, "unconsumed_tail"):
        while data and not unpacker.eof:
            before = unpacker.copy()
            try:
                out = unpacker.decompress(data, STEP)
            except zlib.error:
                for i in range(len(data)):  # once more, byte by byte, as the output of a call that fails is lost
                    yield before.decompress(data[i:i + 1])
                raise
            yield out
            data = unpacker.unconsumed_tail
    else:
        out, at = bytearray(), 0
        try:
            while at < len(data) and not unpacker.eof:
                out += unpacker.decompress(data[at:at + FINE], 1)  # byte by byte, for the same reason
                at += FINE
                while not unpacker.needs_input and not unpacker.eof:
                    out += unpacker.decompress(b"", 1)
                    if len(out) >= STEP:
                        yield bytes(out)
                        out.clear()
        except (OSError, EOFError, lzma.LZMAError, ValueError):
            yield bytes(out)
            raise
        yield bytes(out)
        data = data[at:]
    if unpacker.eof:
        rest.append(unpacker.unused_data + (data if not hasattr(unpacker, "unconsumed_tail") else b""))


def _unpacked(data: Iterator[bytes], keep: bool, whole: list[int]) -> Iterator[bytes]:
    """What the compressed streams at the start of the data hold, one after another; with `keep` also the data behind them.
    whole[0]: bytes of the data read by streams that came to their end."""
    held, read = b"", 0
    while True:
        while len(held) < 6 and (more := next(data, b"")):
            held += more
            read += len(more)
        unpacker = _opened(held)
        if unpacker is None:
            if keep:
                yield from chain([held] if held else [], data)
            return
        rest: list[bytes] = []
        try:
            while not rest:
                for out in _steps(unpacker, held, rest):
                    if out:
                        yield out
                if not rest and not (held := next(data, b"")):
                    if hasattr(unpacker, "flush") and (out := unpacker.flush()):
                        yield out
                    return
                read += 0 if rest else len(held)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        held = rest[0]
        whole[0] = read - len(held)
        while len(held.lstrip(b"\0")) < 6 and (more := next(data, b"")):
            held = held.lstrip(b"\0") + more
            read += len(more)
        if _opened(held.lstrip(b"\0")) is not None:
            held = held.lstrip(b"\0")


def _inflated(raw: memoryview, whole: list[int]) -> Iterator[bytes]:
    """The unpacked data in overlapping pieces, streams inside streams as well, to DEEPEST levels (a file may hold itself)."""
    data = _unpacked((bytes(raw[at:at + FED]) for at in range(0, len(raw), FED)), False, whole)
    for _ in range(DEEPEST):
        head = b""
        while len(head) < 6 and (more := next(data, b"")):
            head += more
        data = chain([head] if head else [], data)
        if _opened(head) is None:
            break
        data = _unpacked(data, True, [0])
    piece, fresh = bytearray(), False
    for out in data:
        piece += out
        fresh = True
        if len(piece) >= PIECE:
            yield bytes(piece)
            del piece[:-OVERLAP]
            fresh = False
    if fresh:
        yield bytes(piece)


def _worth(text: str) -> bool:
    """Whether a text holds a match or something to unwrap; decoded bytes that hold neither are no layer."""
    return bool(
        ESCAPED_URL.search(text) or ESCAPED_UNICODE.search(text) or next(matches(text), None) or next(_runs(text), None))


def _texts(raw: bytes, placed: bool = True) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The bytes read as text, with the bytes (first, behind the last) of each character if `placed`. A byte that is not UTF-8 becomes a
    character of its own. With NUL bytes they are read as UTF-16 as well, in either order and from either byte on."""
    plain = raw.decode("utf-8", "surrogateescape")
    if _worth(plain) and not placed:
        yield plain, np.zeros(0, np.int64), np.zeros(0, np.int64)
    elif _worth(plain):
        codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
        widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        widths[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
        last = np.cumsum(widths)
        yield plain, last - widths, last
    if b"\0" not in raw:
        return
    for ways in ((("<u2", 0), (">u2", 1)), ((">u2", 0), ("<u2", 1))):  # both of a pair read much the same characters
        best = max((_utf16(raw, *way) for way in ways), key=lambda x: x[0])
        if best[0]:
            first = best[2] + 2 * np.arange(len(best[1]), dtype=np.int64)
            yield best[1], first, first + 2


def _utf16(raw: bytes, order: str, skip: int) -> tuple[int, str, int]:
    """The characters of matches and further layers in it, the text and the bytes before it."""
    units = np.frombuffer(raw, order, max(0, len(raw) - skip) // 2, min(skip, len(raw) - 1))
    plain = units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    if not _worth(plain):
        return 0, plain, skip
    inner = [m.span() for p in (ENCODED, ESCAPED_URL, ESCAPED_UNICODE) for m in p.finditer(plain)]
    return 1 + sum(e - s for s, e in inner) + sum(e - s for _, s, e in matches(plain)), plain, skip


def _from_bytes(raw: bytes, place) -> Iterator[Layer]:
    """Layers of the compressed streams anywhere in the bytes; all characters of one stand for
    place(its first byte, its bytes or 0 if it has no end so far)."""
    at, view = 0, memoryview(raw)
    while m := MAGIC.search(raw, at):
        whole = [0]
        for piece in _inflated(view[m.start():], whole):
            for plain, _, _ in _texts(piece, placed=False):
                start, end = place(m.start(), whole[0])
                yield Layer(plain, np.broadcast_to(np.int64(start), len(plain)), np.broadcast_to(np.int64(end), len(plain)))
        at = m.start() + max(1, whole[0])


def _runs(text: str) -> Iterator[tuple[str, int, np.ndarray]]:
    """Base64 digits, the end of their run with its padding, and their places: each line on its own, then lines joined. Joined
    lines end where one is padded or something else than a line end follows."""
    for m in ENCODED.finditer(text):
        yield m[1], m.end(), np.arange(*m.span(1))
    if any(end in text for end in ("\n", "\r", "\\n")):
        for m in WRAPPED.finditer(text):
            at, spans = m.start(), []
            for line_end in LINE_END.finditer(text, *m.span(1)):
                spans.append((at, line_end.start()))
                at = line_end.end()
            spans.append((at, m.end(1)))
            if sum(end - start for start, end in spans) >= SHORTEST:
                yield "".join(text[start:end] for start, end in spans), m.end(), np.concatenate([np.arange(*span) for span in spans])


def _from_base64(layer: Layer) -> Iterator[Layer]:
    for run, stop_at, at in _runs(layer.text):
        digits = run.replace("-", "+").replace("_", "/")
        for skip in range(4):  # the run may begin before the encoded part does
            body = digits[skip:]
            body = body[:len(body) - (len(body) % 4 == 1)]
            if len(body) < SHORTEST:
                break
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            yield from _from_bytes(raw, lambda i, n, skip=skip, at=at, stop_at=stop_at: layer.place(int(at[skip + i * 8 // 6]), stop_at))
            for plain, first, last in _texts(raw):
                begin, stop = skip + first * 8 // 6, skip + -(-last * 8 // 6)
                # Only the places of the run are made: arrays as long as the layer would cost its length for every run.
                behind = layer.ends_of(at[np.minimum(stop, skip + len(body)) - 1])
                behind[-1] = layer.ends_of(np.array([stop_at - 1]))[0]  # the padding belongs to the last character
                yield Layer(plain, layer.starts_of(at[begin]), behind)


def _from_escaped_bytes(layer: Layer) -> Iterator[Layer]:
    """Layers of compressed bytes written with escapes, up to the end of what was unpacked, or of the literal or run."""
    text = layer.text
    for mark, runs, units in (("%", URL_RUN, URL_BYTE), ("\\", SOURCE_RUN, SOURCE_BYTE)):
        for m in runs.finditer(text) if mark in text and ESCAPED_MAGIC.search(text) else ():
            if mark not in m.group() or not ESCAPED_MAGIC.search(m.group()):
                continue
            raw, at = bytearray(), []
            for u in units.finditer(text, *m.span()):
                if u[1]:
                    raw.append(int(u[1], 16))
                elif mark == "%":
                    raw.append(32 if u[0] == "+" else ord(u[0]))
                elif u[2]:
                    raw.append(int(u[2], 16))
                else:
                    raw.append(PLAIN_ESCAPES[u[3]] if u[3] else ord(u[0]))
                at.append(u.start())
            at.append(m.end())

            def place(i: int, n: int, at=at, end=m.end()) -> tuple[int, int]:
                if n:
                    return layer.place(at[i], at[i + n])
                quote = text[at[i] - 1:at[i]]
                closed = re.compile(rf"(?:[^{quote}\\]|\\.)*").match(text, at[i], end) if quote in ("'", '"') else None
                return layer.place(at[i], max(at[i] + 1, closed.end()) if closed else end)

            yield from _from_bytes(bytes(raw), place)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside."""
    if "%" in layer.text and (inner := _replaced(layer, ESCAPED_URL, _from_url)):
        yield inner
    if ("\\" in layer.text or "&#" in layer.text) and (inner := _replaced(layer, ESCAPED_UNICODE, _from_unicode)):
        yield inner
    yield from _from_escaped_bytes(layer)
    yield from _from_base64(layer)


def find_secrets(text: str) -> Found:
    """All spans by start, then kind: those of the text itself, and those found in its layers."""
    base = set(matches(text))
    spans, seen, work = set(base), set(), deque([Layer(text)])
    while work:
        for inner in unwrapped(work.popleft()):
            span = inner.place(0, len(inner.text)) if inner.text else (0, 0)
            mark = (hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest(), span)
            if not inner.text or mark in seen:
                continue
            seen.add(mark)
            spans.update((kind, *inner.place(s, e)) for kind, s, e in matches(inner.text))
            work.append(inner)
    return [(k, s, e, (k, s, e) in base) for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and their spans."""
    return with_spans(docs, find_secrets, keep, text)


def masked(text: str, mark: str) -> str:
    """The text with every span replaced by the mark, overlapping spans as one."""
    out, at = [], 0
    for start, end in sorted({(s, e) for _, s, e, _ in find_secrets(text)}, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, columns: list[str], mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the mark, overlapping spans as one; n_chars follows the text.

    The text is put together where its spans are found, in time that grows with its length.
    """
    rows = docs.select(*[f"`{c}`" for c in columns])
    place = columns.index("text")

    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            fresh = [t if t is None else masked(t, mark) for t in texts]
            arrays = [part.column(i) for i in range(len(columns))]
            arrays[place] = pa.array(fresh, pa.string())
            if "n_chars" in columns:
                old = part.column("n_chars").to_pylist()
                counts = [n if f == t else len(f) for n, t, f in zip(old, texts, fresh, strict=True)]
                arrays[columns.index("n_chars")] = pa.array(counts, part.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return small_batches(rows).mapInArrow(run, rows.schema)
