"""Filters per query and block bounds: the same answers as one search each, and as scoring every chunk."""

import random

import pytest
from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.operators import blockmax, fulltext, nearest, scopes
from seekspark.operators.topk import best_per_query
from seekspark.plans import search

CFG = EngineConfig(watch_root="/x", embedding_dim=4, hybrid_depth=6, cross_encoder_enabled=False)
PATHS = [f"{d}/f{i}{e}" for i in range(12) for d in ("src", "lib/a", "lib", ".claude/docs", "config") for e in (".rb", ".d.ts", ".yml", ".md")]
SETTINGS = [
    {}, {"path_prefix": "lib\\"}, {"ext": "rb, .D.ts"}, {"lang": "yaml"}, {"glob": "*[0-4].md"}, {"glob": "lib/**/f1*.rb", "ext": "rb"},
    {"include_docs": True}, {"path_prefix": ".claude", "lang": "ruby"}, {"path_prefix": "nowhere"}, {"glob": "src/**", "lang": "ruby"},
]
COLUMNS = "query_id long, query string, query_classifier string, vector array<float>, path_prefix string, ext string, lang string, glob string, include_docs boolean, limit int"


def corpus(spark, n=None, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(f"{p}#0", p, 1, 1, " ".join(rng.choice(vocabulary[: rng.choice([3, 10, 30])]) for _ in range(rng.randint(0, 25))), [rng.random() for _ in range(4)], "")
            for p in PATHS[:n]]
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, start_line int, end_line int, body string, vector array<float>, definition_of string").repartition(3).cache()
    posted = fulltext.postings(chunks, F.col("body"), ("chunk_id", "path")).cache()
    return search.SearchTables(chunks, posted, fulltext.corpus_stats(chunks, posted).cache(), blocks=blockmax.term_blocks(posted))


def requests(spark, seed=2, settings=SETTINGS):
    rng = random.Random(seed)
    rows = []
    for i in range(2 * len(settings)):
        s = settings[i % len(settings)]
        query = " " if i == 3 else " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 6)))
        rows.append((i, query, ["auto", "docs"][i % 2], [rng.random() for _ in range(4)], s.get("path_prefix"), s.get("ext"), s.get("lang"), s.get("glob"), s.get("include_docs", i % 3 == 0 and None), rng.choice([1, 3, 9])))
    return rows, spark.createDataFrame(rows, COLUMNS)


def listed(frame, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select(*columns).collect())


def test_scopes_accept_what_the_predicates_of_one_request_accept(spark):
    rows, frame = requests(spark)
    named, blocks = scopes.compile_scopes(frame, CFG)
    ids = {r.query_id: r.scope_id for r in named.collect()}
    assert len(set(ids.values())) == len(SETTINGS)  # null and false are one setting of include_docs
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {r.path: set(r.scopes) for r in scopes.accepting(paths, blocks[0], CFG).collect()}
    for row in rows[: len(SETTINGS)]:
        one = search.SearchRequest("x", path_prefix=row[4], ext=row[5], lang=row[6], glob=row[7], include_docs=bool(row[8]))
        allowed = search.path_scope(one, CFG).predicate
        want = {r.path for r in (paths if allowed is None else paths.filter(allowed)).collect()}
        assert {p for p, found in got.items() if ids[row[0]] in found} == want, row


@pytest.mark.parametrize("small", [False, True])
def test_a_batch_answers_as_single_searches(spark, monkeypatch, small):
    monkeypatch.setattr(blockmax, "ONE_PASS", 0 if small else 1 << 40)
    if small:  # several blocks of scopes and of queries, joins by shuffle
        monkeypatch.setattr(scopes, "SCOPE_BLOCK", 4)
        monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
        for name in ("MAX_BROADCAST_TERMS", "MAX_PUSHED_TERMS", "MAX_BROADCAST_CANDIDATES"):
            monkeypatch.setattr(blockmax, name, 0)
    settings = SETTINGS[1:6] if small else SETTINGS
    tables = corpus(spark)
    rows, frame = requests(spark, settings=settings)
    hits, levels, rejected = search.search_requests(frame, tables, CFG)
    columns = ("query_id", "ord", "chunk_id", "score", "rerank_score", "text", "retrieval_mode")
    got = listed(hits, *columns)
    for row in rows[:: 5 if small else 6]:
        one = search.SearchRequest(row[1], row[9], row[4], row[2], None, bool(row[8]), row[5], row[6], row[7])
        single, _ = search.search_plan(frame.filter(F.col("query_id") == row[0]), tables, CFG, one)
        assert [g for g in got if g[0] == row[0]] == listed(single, *columns), row
    assert rejected.count() == 0 and levels.count() == len(rows)


def test_faulty_requests_are_rejected_alone(spark):
    rows = [(0, "w1", "auto", [0.1] * 4, None, None, None, None, None, 5), (1, "w1", "auto", [0.1] * 4, None, None, "klingon", None, None, 5),
            (2, "w1", "auto", [0.1] * 4, None, None, None, "{a", None, 5), (3, "", "auto", [0.1] * 4, None, None, None, None, None, 5),
            (4, "w1", "auto", [0.1] * 4, None, None, None, "@(a", None, 51), (5, "w1", "x", [0.1] * 4, None, None, None, None, None, 5)]
    hits, levels, rejected = search.search_requests(spark.createDataFrame(rows, COLUMNS), corpus(spark, 40), CFG)
    assert {r.query_id for r in hits.collect()} >= {0} and {r.query_id for r in levels.collect()} == {0, 2}
    errors = {r.query_id: r.error for r in rejected.collect()}
    assert set(errors) == {1, 3, 4, 5} and "klingon" in errors[1]
    empty, _, _ = search.search_requests(spark.createDataFrame([], COLUMNS), corpus(spark, 40), CFG)
    assert empty.count() == 0


def test_arguments_a_batch_lacks_filter_nothing(spark):
    _, frame = requests(spark)
    hits, _, rejected = search.search_requests(frame.select("query_id", "query", "query_classifier", "vector"), corpus(spark), CFG)
    assert rejected.count() == 0 and hits.filter("path LIKE '.claude%'").count() == 0


@pytest.mark.parametrize(("k", "few"), [(1, True), (5, True), (40, False)])
def test_block_bounds_lose_no_hit_and_read_less(spark, monkeypatch, k, few):
    monkeypatch.setattr(blockmax, "ONE_PASS", 0)
    if not few:
        for name in ("MAX_BROADCAST_TERMS", "MAX_PUSHED_TERMS", "MAX_BROADCAST_CANDIDATES"):
            monkeypatch.setattr(blockmax, name, 0)
    rng = random.Random(k)
    texts = [" ".join([f"c{rng.randrange(4)}" for _ in range(rng.randint(5, 60))] + [f"r{rng.randrange(300)}" for _ in range(rng.randint(0, 6))]) for _ in range(900)]
    texts += [texts[0]] * 30
    frame = spark.createDataFrame([(f"d{i:04}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    posted = fulltext.postings(frame, F.col("text")).cache()
    stats, blocks = fulltext.corpus_stats(frame, posted).cache(), blockmax.term_blocks(posted)
    asked = [f"c{rng.randrange(4)} c1 c2 r{rng.randrange(300)} r{rng.randrange(300)} r{rng.randrange(300)}" for _ in range(12)] + ["c0 c1 c2 c3", "r5", "unheard", "c1 c1 r7", texts[0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    whole = best_per_query(fulltext.bm25(queries, posted, stats), k, F.col("score").desc(), F.col("chunk_id"))
    got = blockmax.best_chunks(queries, posted, stats, blocks, k)
    columns = ("query_id", "ord", "chunk_id", "score")
    assert listed(got, *columns) == listed(whole, *columns)
    if k == 5 and few:
        met = blockmax.query_blocks(queries, blocks, stats, 1.2, 0.75).cache()
        source = blockmax._Postings(posted, stats, 1.2, 0.75, False)
        bars = blockmax._bars(source, met, k)
        read = source.of(blockmax.with_roles(met, bars).filter("essential")).count()
        assert read < 0.5 * source.of(met).count()
        monkeypatch.setattr(blockmax, "MAX_PUSHED_TERMS", 256)
        one = source.of(met.filter("query_id = 13"))._jdf.queryExecution().optimizedPlan().toString()
        assert "r5" in one
