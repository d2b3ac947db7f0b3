"""License matches against a plain comparison of every window with every template, and the bound on the bands."""

import random
import re

import pytest

from seekspark.llm import licenses


def plain(rows):
    out = {}
    for key, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
        for name, template in licenses.TEMPLATES.items():
            tw = re.findall("[a-z0-9]+", template.lower())
            whole = {" ".join(tw[i:i + 3]) for i in range(len(tw) - 2)}
            c = licenses.width_class(len(whole))
            for j in range(0, (len(sh) - 1) // c + 1 if sh else 0):
                n = len(whole & set(sh[j * c:j * c + 2 * c]))
                if n >= 0.8 * len(whole):
                    old = out.get((key, name))
                    if old is None or (n, -j * c) > (old[1], -old[2]):
                        out[key, name] = (n / len(whole), n, j * c)
    return out


def test_width_classes():
    assert [licenses.width_class(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 17, 24, 25)] == [1, 2, 3, 4, 6, 6, 8, 8, 12, 12, 16, 24, 24, 32]
    for n in range(1, 300):
        c = licenses.width_class(n)
        assert n <= c <= 1.5 * n
        bands, similar = licenses.bands_needed(n, c, 0.8), 0.8 * n / (2 * c + 0.2 * n)
        assert (1 - similar) ** bands <= licenses.MISS


def test_matches_equal_a_plain_comparison(spark):
    rng = random.Random(3)
    filler = "the of and to license under permission is granted software version public general any copy use work".split()
    rows = []
    for i in range(400):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 80))]
        for template in rng.sample(list(licenses.TEMPLATES.values()), rng.choice([0, 1, 1, 2])):
            cut = template.split()
            if rng.random() < 0.5:
                cut[rng.randrange(len(cut))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = cut
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "MIT License"), (1003, "Releasedé under the MIT License"), (1004, "RELEASED UNDER\nTHE MIT, LICENSE!"), (7, rows[7][1]), (None, rows[8][1]),
             (1005, "Licensed under CC BY-NC 4.0. " * 3000)]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, license string, size int")
    got = {(r.doc_id, r.license): (r.containment, r.matched, r.window_start) for r in licenses.scan(frame).collect()}
    want = plain(rows)
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert (1004, "mit") in got
    assert licenses.scan(frame.limit(0)).count() == 0


def test_a_template_needs_a_shingle(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([], "doc_id long, text string"), {"x": "two words"})
