"""Terms divided in one pass over the bytes, against the regex."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekspark.functions.text import index_terms
from seekspark.config import EngineConfig
from seekspark.operators import blockmax, embedding, fulltext, words
from seekspark.plans.index import CodeIndex

TEXTS = ["", "a", "A_b-c9", "é", "aéKb", "İx", " lead trail ", "x" * 50, None, "\x00q\x00", "日本a語b", "end", "start"]


@pytest.mark.parametrize("size", [1 << 22, 7])
def test_terms_are_those_of_the_regex(monkeypatch, size):
    monkeypatch.setattr(words, "BYTES", size)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab_9 -é語", k=rng.randrange(30))) for _ in range(300)]
    for kind in (pa.string(), pa.large_string()):
        held = pa.array(["cut off", *texts], kind).slice(1)
        got = []
        for at, stop in words.pieces(held):
            found, lengths = words.terms_of(held.slice(at, stop - at))
            ends = np.cumsum(lengths)
            got += [found[int(e - n):int(e)].to_pylist() for e, n in zip(ends, lengths)]
        assert got == [re.findall("[a-z0-9_]+", t or "") for t in texts]
    assert words.terms_of(pa.array([], pa.string()))[0].to_pylist() == []
    assert words.terms_of(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_postings_make_no_list_of_strings_and_hold_the_same_terms(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS * 3)), "chunk_id bigint, text string")
    posted = fulltext.postings(frame, F.col("text"))
    assert "regexp_extract_all" not in posted._jdf.queryExecution().toString()
    plain = frame.select("chunk_id", F.explode(index_terms(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, posted.select("chunk_id", "term", "tf").collect())) == sorted(map(tuple, plain.collect()))


def test_the_stand_in_embedder_divides_all_texts_at_once(monkeypatch):
    texts = [t or "" for t in TEXTS] + ["one two two", "TWO"]
    whole = embedding.hashing_embedder(8)(texts)
    monkeypatch.setattr(words, "BYTES", 5)
    assert np.array_equal(whole, embedding.hashing_embedder(8)(texts))
    assert np.array_equal(whole, np.concatenate([embedding.hashing_embedder(8)([t]) for t in texts]))
    assert not hasattr(embedding, "re")


def test_counts_of_texts_are_those_of_their_postings(spark, monkeypatch):
    rows = [(i % 3, f"t{i % 70} t{i % 7} " * (1 + i % 5) + "same é" * (i % 11)) for i in range(900)] + [(0, None), (1, ""), (5, "x " * 70000)]
    chunks = spark.createDataFrame(rows, "key int, text string").withColumn("chunk_id", F.monotonically_increasing_id()).repartition(3).cache()
    columns = ["key", "term", "level", "df", "max_tf", "min_dl"]
    expected = sorted(map(tuple, blockmax.term_blocks(fulltext.postings(chunks, F.col("text"), ("chunk_id", "key")), "key").select(*columns).collect()))
    for least, size in ((50, 200), (1 << 21, 1 << 22)):
        monkeypatch.setattr(blockmax, "ROWS", least)
        monkeypatch.setattr(words, "BYTES", size)
        got = blockmax.added(blockmax.text_counts(chunks, F.col("text"), "key"), "key").select(*columns).collect()
        assert sorted(map(tuple, got)) == expected
    assert blockmax.text_counts(chunks.limit(0), F.col("text"), "key").isEmpty()


def test_levels_in_tasks_are_those_of_the_plan(spark):
    pairs = [(tf, tf << n) for n in range(22) for tf in (1, 2, 3, 7, 1000)] + [(tf, dl) for tf in range(1, 40) for dl in range(tf, 700)]
    frame = spark.createDataFrame(pairs, "tf bigint, dl bigint").select(blockmax.level(F.col("tf"), F.col("dl")).alias("l"))
    tf, dl = np.array(pairs).T
    assert [r.l for r in frame.collect()] == blockmax.level_of(tf, dl).tolist()


def test_an_index_counts_terms_without_reading_its_postings(spark, tmp_path, monkeypatch):
    plans, write = {}, CodeIndex._write

    def seen(self, frame, name, version, *order):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        write(self, frame, name, version, *order)

    monkeypatch.setattr(CodeIndex, "_write", seen)
    index = CodeIndex(spark, EngineConfig(watch_root="/x", embedding_dim=4, index_dir=str(tmp_path / "i"), path_buckets=2)).open()
    index.index_table(spark.createDataFrame([("a.py", "def f():\n  pass\n"), ("b.md", "words words")], "path string, text string"))
    assert "ReadSchema: struct<header:string,body:string>" in plans["term_df"]
