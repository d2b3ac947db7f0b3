"""The mix against its SQL, its guarantees, and the Pareto order against inclusion probabilities."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seekspark.llm import mixing
from seekspark.llm.queries import ORACLE, QUERIES

DDL = "doc_id long, text string, source string, size string, u string, target string"


def by_sql(rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    return Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.MIX_SQL})").fetchall())


def by_spark(frame):
    return Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(frame).collect())


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(rng.choice([1, 5, 60, 900])):
        source = rng.choice(["a", "a", "a", "a", "b", "ä", "z", None, f"s{rng.randint(0, 8)}"])
        text = rng.choice([None, "", " \t\n", *[" ".join("w" for _ in range(rng.randint(1, 300)))] * 9])
        rows.append((i if rng.random() < 0.98 else None, text, source, "x", "y", "z"))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_the_mix_equals_its_sql_and_keeps_its_word(spark, seed):
    rows = sample(seed)
    frame = spark.createDataFrame(rows, DDL).repartition(3)
    got = by_spark(frame)
    assert got == by_sql(rows) == by_spark(frame)
    source = {r[0]: r[2] for r in rows if r[0] is not None}
    taken, target, largest = Counter(), {}, Counter()
    for (key, size, source_size, aim, words), n in got.items():
        assert 0 <= words <= 2 * size and (size == 0 or words % size == 0) and aim <= 2 * source_size + 1e-6
        if key is not None:
            taken[source[key]] += words * n
            target[source[key]] = aim
            largest[source[key]] = max(largest[source[key]], size)
    if not any(r[0] is None for r in rows):
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)


def test_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b c", "s", None, None, None)] * 7, DDL)
    assert sum(r.taken for r in mixing.mix(frame).collect()) in (30, 33)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_whole_copies_and_clashing_columns(spark):
    rows = sample(3)
    frame = spark.createDataFrame(rows, DDL)
    copies = Counter(tuple(r) for r in mixing.mixed_documents(frame, frame.columns).collect())
    taken = {k[0]: k[4] for k in by_spark(frame) if k[0] is not None}
    for row in rows:
        size = len((row[1] or "").split())
        if row[0] is not None:
            assert copies[row] == (taken[row[0]] // size if size else 1)


def test_inclusion_follows_the_wishes(spark):
    """Over many seeds a document's mean number of copies comes near what it was promised."""
    rows = [(i, " ".join("w" for _ in range(4 + 60 * (i % 2))), "s" if i < 60 else "t", None, None, None) for i in range(100)]
    frame = spark.createDataFrame(rows, DDL)
    total = Counter()
    turns = 25
    for turn in range(turns):
        rows_out = mixing.mix(frame, seed=f"t{turn}").filter(F.col("size") > 0)
        for r in rows_out.collect():
            total["long" if r["size"] > 9 else "short", "s" if r.doc_id < 60 else "t"] += r.taken // r["size"]
    mean = {k: v / turns for k, v in total.items()}
    for source in "st":
        assert mean["long", source] > mean["short", source] * 0.99  # longer documents have the larger wish


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    frame = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(frame.columns)
    relation = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})")
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(map(repr, relation.fetchall()))
