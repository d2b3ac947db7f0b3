"""Recall and exact scores against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.llm import neighbours
from seekspark.llm.neighbours import CurveConfig


def brute(rows, k=5, every=5):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float32).astype(np.float64)
    units = v / np.sqrt((v * v).sum(axis=1))[:, None]
    out = {}
    for i in range(0, len(rows)):
        if ids[i] % every:
            continue
        s = units @ units[i]
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[j]) for j in order]
    return out


def run(spark, rows, config, every=5):
    frame = spark.createDataFrame([(i, [float(x) for x in v], 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(4)
    got = {}
    for r in neighbours.search(frame, F.col("id") % every == 0, config=config).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 24))
    if kind == "clustered":
        v = rng.standard_normal((300, 24))[rng.integers(0, 300, 3000)] + 0.05 * v
    rows = list(enumerate(v.astype(np.float32)))
    rows += [(3000 + i, rows[7][1]) for i in range(200)]  # a very common vector
    want = brute(rows)
    got = run(spark, rows, CurveConfig(block=128, sample=128))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 5 * len(want)
    for q in want:
        true = dict(want[q])
        assert all(abs(s - true[i]) < 1e-12 for i, s in got[q] if i in true)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    common = [i for i, _ in got[3005]]
    assert common == [7, 3000, 3001, 3002, 3003]


def test_defined_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(0, one), (5, [2.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0]), (15, None), (20, [0.0, 0.0, 0.0]), (25, [math.nan, 1.0, 0.0]), (30, [math.inf, 1.0, 0.0]),
            (35, [1.0, None, 0.0]), (40, [1.0]), (None, one), (5, [9.0, 1.0, 0.0]), (45, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(frame, F.col("id") % 5 == 0).collect()]
    assert sorted(got) == [(0, 1, 5, 1.0), (0, 2, 10, 0.0), (5, 1, 0, 1.0), (5, 2, 10, 0.0), (10, 1, 0, 0.0), (10, 2, 5, 0.0)]
    assert neighbours.search(frame.limit(0), F.col("id") % 5 == 0).count() == 0
    assert neighbours.search(frame.filter("vec_id = 0"), F.col("id") % 5 == 0).count() == 0


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [0.0, 1.0]), (3, [1e-200, 1e-201]), (4, [-1e308, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in neighbours.search(frame, F.col("id") == 0).orderBy("rank").collect()]
    near = 1 / math.sqrt(1.01)
    assert {i for i, _ in got[:2]} == {1, 3} and [i for i, _ in got[2:]] == [2, 4]  # the first two tie but for rounding
    assert all(abs(s - w) < 1e-12 for (_, s), w in zip(got, [near, near, 0.0, -1.0], strict=True))


def test_windows_are_a_part_of_the_data(spark, monkeypatch):
    used, measure = [], neighbours._measured

    def measured(*arguments):
        used.append((arguments[2], *measure(*arguments)))
        return used[-1][1:]

    monkeypatch.setattr(neighbours, "_measured", measured)
    rng = np.random.default_rng(2)
    rows = list(enumerate(rng.standard_normal((6000, 32)).astype(np.float32)))
    want, got = brute(rows, every=50), run(spark, rows, CurveConfig(), every=50)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    (n, curves, window), = used
    assert curves > 1 and 2 * window < n / 2
