"""Vector codes against plain Lloyd rounds in integers of any size, and the partial rescans against full ones."""

import hashlib
import math
import random

import numpy as np
import pytest

from seekspark.llm import codes


def plain(rows, rounds=4, entries=256):
    """rows: (id, label, vector) of usable vectors of one length that 4 divides."""
    bound = codes.component_bound(len(rows[0][2]))
    ints = [[max(-bound, min(bound, math.floor(1024 * x))) for x in v] for _, _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    width = len(ints[0]) // 4
    part = lambda i, p: ints[i][p * width:(p + 1) * width]
    books = [[part(i, p) for i in order[:entries]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for number in range(rounds + 1):
        near = [[nearest(part(i, p), books[p]) for p in range(4)] for i in range(len(rows))]
        for p in range(4) if number < rounds else ():
            for j in range(len(books[p])):
                own = [part(i, p) for i in range(len(rows)) if near[i][p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    error = [sum(d for d, _ in n) for n in near]
    sums = {}
    for (_, label, _), e in zip(rows, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    return sorted(((key, "".join(f"{j:02x}" for _, j in n), e, min(sums[label], (1 << 63) - 1), digest) for (key, label, _), n, e in zip(rows, near, error, strict=True)), key=str)


def run(spark, rows, kind="float", **more):
    frame = spark.createDataFrame([(k, label, v, "x", 1) for k, label, v in rows], f"vec_id long, label int, embedding array<{kind}>, code string, _near int")
    got = codes.compress(frame.repartition(3), **more)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def vectors(n, dims, seed=1, digits=3):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 1, 2]), [float(np.float32(round(rng.gauss(0, 0.2), digits))) for _ in range(dims)]) for i in range(n)]


def test_codes_equal_plain_lloyd(spark):
    rows = vectors(700, 8, digits=2)
    rows += [(5, None, rows[5][2]), (3, 1, rows[9][2]), (None, 2, rows[11][2])] + [(1000 + i, 4, rows[0][2]) for i in range(60)]
    bad = [(2000, 1, None), (2001, 1, []), (2002, 1, [None] * 8), (2003, 1, [float("nan")] * 8), (2004, 1, [float("inf")] + [0.0] * 7), (2005, 1, [1.0] * 7)]
    assert run(spark, rows + bad) == plain(rows)


def test_few_rows_and_none(spark):
    rows = vectors(3, 4)
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == run(spark, [(1, 1, None)]) == []


def test_extreme_components_and_odd_lengths(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.choice([-1, 1]) * rng.choice([1e-3, 1.0, 4e4, 1e5, 1e300]) * rng.random() for _ in range(8)]) for i in range(300)]
    assert run(spark, rows, "double") == plain(rows)
    odd = [(i, 1, v[:6]) for i, _, v in vectors(20, 8)]
    assert run(spark, odd) == plain([(k, label, [*v, 0.0, 0.0]) for k, label, v in odd])


@pytest.mark.parametrize("scale", [8, 1 << 27])
def test_active_entries_give_what_a_full_scan_gives(scale):
    rng = np.random.default_rng(3)
    x = rng.integers(-scale, scale, (400, 3))
    entries = rng.integers(-scale, scale, (40, 3))
    code, near = codes.assign(x, entries, None, None, None)
    for share in (0.0, 0.1, 0.5, 1.0):
        fresh = np.where(rng.random((40, 1)) < share, rng.integers(-scale, scale, (40, 3)), entries)
        fresh[7] = fresh[3]
        moved = (fresh != entries).any(axis=1)
        code, near = codes.assign(x, fresh, moved, code, near)
        want = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(row, e, strict=True)) for e in fresh] for row in x])
        assert (near == want.min(axis=1)).all() and (code == want.argmin(axis=1)).all()
        entries = fresh
