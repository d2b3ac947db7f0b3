import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.config import ConfigError, EngineConfig
from seekspark.operators import embedding, fulltext, nearest
from seekspark.operators.fusion import leg_depth, reciprocal_rank
from seekspark.operators.rerank import cross_encode, last_logits
from seekspark.plans.search import SearchRequest, SearchTables, path_scope, retrieve


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 8)).astype(np.float32)
    data[10:14] = data[9]  # equal vectors tie and order by id
    frame = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(data)], "chunk_id string, vector array<float>")
    asked = rng.normal(size=(7, 8)).astype(np.float32)
    asked[0] = data[9]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, vector array<float>")
    best = {}
    for i, q in enumerate(asked.astype(float)):
        d = ((data.astype(float) - q) ** 2).sum(axis=1)
        best[i] = [f"c{j:02d}" for j in sorted(range(60), key=lambda j: (d[j], j))[:6]]
    return frame.repartition(3), queries, best


@pytest.mark.parametrize("block", [1024, 3])
def test_nearest_is_exact_in_one_block_and_in_many(vectors, block, monkeypatch):
    frame, queries, best = vectors
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    got = {}
    for r in nearest.nearest(queries, frame, 6).orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == best


def test_nearest_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    data = 1e5 + rng.normal(size=(3000, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "chunk_id bigint, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(0, data[0].tolist())], "query_id bigint, vector array<double>")
    d = ((data - data[0]) ** 2).sum(axis=1)
    assert [r.chunk_id for r in nearest.nearest(queries, frame, 10).orderBy("ord").collect()] == np.lexsort((np.arange(3000), d))[:10].tolist()


def test_vectors_of_unequal_length_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0])], "chunk_id bigint, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 2.0])], "query_id bigint, vector array<double>")
    for held in (frame, frame.filter("chunk_id = 0")):
        with pytest.raises(Exception, match="length"):
            nearest.nearest(queries, held, 1).collect()


def bm25_by_hand(docs, query, k1=1.2, b=0.75):
    terms = {d: re.findall("[a-z0-9_]+", t.lower()) for d, t in docs.items()}
    mean = sum(map(len, terms.values())) / len(terms)
    out = {}
    for d, words in terms.items():
        score = 0.0
        for t in re.findall("[a-z0-9_]+", query.lower()):
            df = sum(t in w for w in terms.values())
            if tf := words.count(t):
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
        if score:
            out[d] = round(score, 6)
    return out


@pytest.mark.parametrize("few", [True, False])
def test_bm25_broadcast_and_salted(spark, few):
    docs = {"a": "the cat the dog", "b": "the the the", "c": "", "d": "Cat_1 cat", "e": "the"}
    frame = spark.createDataFrame(list(docs.items()), "chunk_id string, body string")
    posted = fulltext.postings(frame, F.col("body"))
    queries = spark.createDataFrame([(0, "the cat the"), (1, "Cat_1"), (2, "none")], "query_id bigint, query string")
    rows = fulltext.bm25(queries, posted, fulltext.corpus_stats(frame, posted), few_terms=few).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.chunk_id] = round(r.score, 6)
    assert got == {0: bm25_by_hand(docs, "the cat the"), 1: bm25_by_hand(docs, "Cat_1")}


def test_fusion_is_symmetric(spark):
    one = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id bigint, chunk_id string, ord int")
    two = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id bigint, chunk_id string, ord int")
    rows = lambda f: {r.chunk_id: r.score for r in f.select("chunk_id", "score").collect()}
    assert rows(reciprocal_rank(one, two)) == rows(reciprocal_rank(two, one))
    assert rows(reciprocal_rank(one, two))["b"] == pytest.approx(1 / 61 + 1 / 62)
    assert (leg_depth(100, 10, False), leg_depth(100, 10, True), leg_depth(500, 10, True)) == (100, 400, 2000)
    assert (nearest.over_fetch(10, False, True), nearest.over_fetch(10, True, False), nearest.over_fetch(10, False, False)) == (200, 80, 10)


def test_blank_queries_use_vectors_and_filters_come_first(spark):
    rows = [("lib/a.rb#0", "lib/a.rb", "cat", [0.0, 1.0]), ("src/b.ts#0", "src/b.ts", "cat cat", [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, body string, vector array<float>")
    posted = fulltext.postings(chunks, F.col("body"), ("chunk_id", "path"))
    tables = SearchTables(chunks, posted, fulltext.corpus_stats(chunks, posted))
    queries = spark.createDataFrame([(0, " ", [1.0, 0.0]), (1, "cat", [1.0, 0.0])], "query_id bigint, query string, vector array<float>")
    cfg = EngineConfig()
    found = retrieve(queries, tables, path_scope(SearchRequest("x"), cfg), 10, cfg).collect()
    got = {(r.query_id, r.ord): (r.chunk_id, r.retrieval_mode, round(r.score, 6)) for r in found}
    assert got[0, 1] == ("src/b.ts#0", "vector", 1.0)
    assert got[1, 1] == ("src/b.ts#0", "hybrid", round(2 / 61, 6))
    only = retrieve(queries, tables, path_scope(SearchRequest("x", path_prefix="lib"), cfg), 1, cfg).collect()
    assert {(r.query_id, r.chunk_id) for r in only} == {(0, "lib/a.rb#0"), (1, "lib/a.rb#0")}


def test_cross_encoder_orders_by_logit_and_falls_back(spark):
    hits = spark.createDataFrame(
        [(q, n, f"c{n}", "x" * n, 0.5, 0.9 - n / 10) for q in (0, 1) for n in (1, 2, 3)],
        "query_id bigint, ord int, chunk_id string, text string, score double, rerank_score double",
    )
    queries = spark.createDataFrame([(0, "fine"), (1, "boom")], "query_id bigint, query string")

    def scorer():
        def score(asked, passages):
            if "boom" in asked:
                raise RuntimeError("model failed")
            return np.array([float(len(p)) for p in passages])
        return score

    cfg = EngineConfig(cross_encoder_batch=1)
    rows = cross_encode(hits, queries, scorer, 2, cfg).orderBy("query_id", "ord").collect()
    assert [(r.query_id, r.chunk_id, r.cross_encoder_logit) for r in rows] == [(0, "c3", 3.0), (0, "c2", 2.0), (1, "c1", None), (1, "c2", None)]
    assert rows[0].score == pytest.approx(1 / (1 + math.exp(-3))) and rows[2].score == 0.5
    assert last_logits(np.array([[1, 2], [3, 4]])).tolist() == [2, 4]


def test_embedding_helpers(spark):
    assert embedding.rows_of_tensor(np.arange(6), 3).shape == (2, 3)
    with pytest.raises(ValueError):
        embedding.rows_of_tensor(np.arange(5), 3)
    with pytest.raises(ConfigError):
        embedding.embed_column(F.col("t"), EngineConfig(embedding_model="other"))
    made = embedding.embed_column(F.col("t"), EngineConfig(embedding_model="other", embedding_dim=2), lambda: lambda texts: np.array([[len(t), 1] for t in texts]))
    assert spark.createDataFrame([("abc",)], "t string").select(made.alias("v")).first().v == [3.0, 1.0]
    pooled = embedding.mean_pool(np.array([[[3.0, 0.0], [9.0, 9.0]]]), np.array([[1, 0]]))
    assert pooled.tolist() == [[1.0, 0.0]]
    assert np.linalg.norm(embedding.hashing_embedder(16)(["a b c", ""]), axis=1).round(6).tolist() == [1.0, 0.0]
