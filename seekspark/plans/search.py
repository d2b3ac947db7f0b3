"""The search plan: filters, two ranked legs, fusion, rerank, cut, confidence.

One plan serves one query and a table of queries alike; everything is keyed by query_id. Filters
sit below the legs, so they reach the Parquet scans and no candidate slot is lost to them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.config import MAX_LIMIT, MAX_SNIPPET_CHARS, QUERY_CLASSIFIERS, ConfigError, EngineConfig, check_request, resolve_classifier
from seekspark.functions import confidence, paths
from seekspark.functions.globs import all_of
from seekspark.functions.text import index_terms, trim
from seekspark.operators.embedding import embed_column
from seekspark.operators.blockmax import best_chunks, term_blocks
from seekspark.operators.counted import Counted, best_counted
from seekspark.operators.fusion import leg_depth, reciprocal_rank
from seekspark.operators.nearest import nearest, over_fetch, similarity
from seekspark.operators.rerank import (
    PairScorer, cross_encode, query_features, rerank, sort_by_definition, sort_by_focus,
)
from seekspark.operators.scopes import Scope, accepting, compile_scopes
from seekspark.operators.topk import best_per_query
from seekspark.session import written

SMALL_BATCH = 2_000
HIT_COLUMNS = [
    "query_id", "ord", "chunk_id", "path", "start_line", "end_line", "text", "score", "rerank_score",
    "definition_of", "cross_encoder_logit",
]


@dataclass(frozen=True)
class SearchRequest:
    """Arguments of one search."""

    query: str
    limit: int = 10
    path_prefix: str | None = None
    query_classifier: str | None = None
    search_focus: str | None = None
    include_docs: bool = False
    ext: str | Sequence[str] | None = None
    lang: str | None = None
    glob: str | None = None


@dataclass(frozen=True)
class PathScope:
    """The path predicates of a request."""

    prefix: Column | None
    selected: Column | None

    @property
    def narrowing(self) -> bool:
        return self.selected is not None

    @property
    def predicate(self) -> Column | None:
        parts = [p for p in (self.prefix, self.selected) if p is not None]
        return all_of(parts) if parts else None


def path_scope(request: SearchRequest, cfg: EngineConfig) -> PathScope:
    """Prefix, then (ext or lang) and glob, then the omission of working documents."""
    path = F.col("path")
    selected = paths.query_path_predicate(path, request.ext, request.lang, request.glob)
    if paths.omits_working_docs(cfg.working_docs, cfg.search_omit_working_docs, request.include_docs, request.path_prefix):
        outside = ~paths.is_covered_by(path, cfg.working_docs)
        selected = outside if selected is None else outside & selected
    return PathScope(paths.prefix_predicate(path, request.path_prefix), selected)


@dataclass(frozen=True)
class SearchTables:
    """What a search reads. ``postings`` is None where no text index exists.

    ``counted`` stands in for postings, stats and blocks where the batch was known before its texts were divided.
    chunks: chunk_id, path, start_line, end_line, body, vector, definition_of [, path_bucket]
    postings: term, chunk_id, path, tf, dl; stats: one row n_docs, avg_dl; blocks: term, level, df, max_tf, min_dl
    """

    chunks: DataFrame
    postings: DataFrame | None
    stats: DataFrame | None
    path_buckets: int | None = None
    blocks: DataFrame | None = None
    counted: Counted | None = None

    @property
    def has_text(self) -> bool:
        return self.postings is not None or self.counted is not None


def best_by_text(queries: DataFrame, tables: SearchTables, k: int, k1: float = 1.2, b: float = 0.75, allowed: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, ord): the text leg."""
    if tables.counted is not None:
        return best_counted(queries, tables.counted, k, k1, b, allowed)
    return best_chunks(queries, tables.postings, tables.stats, blocks_of(tables), k, k1, b, allowed)


def retrieve(queries: DataFrame, tables: SearchTables, scope: PathScope, limit: int, cfg: EngineConfig) -> DataFrame:
    """(query_id, query, vector) -> (query_id, chunk_id, score, retrieval_mode, ord), at most ``limit`` each.

    Blank queries, a missing text index and hybrid search being off leave the vector leg alone.
    """
    allowed = scope.predicate
    vectors = tables.chunks if allowed is None else tables.chunks.filter(allowed)
    hybrid = cfg.hybrid_search and tables.has_text
    if cfg.compat_overfetch and not hybrid:
        return _overfetched(queries, tables, scope, limit, cfg)
    depth = leg_depth(cfg.hybrid_depth, limit, scope.narrowing) if hybrid else limit
    by_vector = nearest(queries, vectors, max(depth, limit))
    if not hybrid:
        return _by_vector_alone(by_vector.filter(F.col("ord") <= limit))
    by_vector = by_vector.join(queries.select("query_id", is_blank().alias("_blank")), "query_id")
    by_text = best_by_text(queries.filter(~is_blank()), tables, depth, cfg.bm25_k1, cfg.bm25_b, allowed)
    return _blended(by_vector.filter(F.col("_blank") | (F.col("ord") <= depth)), by_text, limit, cfg)


def is_blank() -> Column:
    return trim(F.col("query")) == ""


def _by_vector_alone(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", similarity(F.col("distance")).alias("score"), "ord", F.lit("vector").alias("retrieval_mode"))


def _blended(by_vector: DataFrame, by_text: DataFrame, limit: int, cfg: EngineConfig) -> DataFrame:
    """Both legs fused, at most ``limit`` each. A blank query has no text leg: its hits keep the score of the vector leg."""
    blank = F.coalesce(F.col("_blank"), F.lit(False))
    scores = reciprocal_rank(by_vector, by_text, cfg.rrf_k).select(
        "query_id", "chunk_id", F.when(blank, similarity(F.col("distance"))).otherwise(F.col("score")).alias("score"),
        F.when(blank, "vector").otherwise("hybrid").alias("retrieval_mode"),
    )
    return best_per_query(scores, limit, F.col("score").desc(), F.col("chunk_id"))


def retrieve_each(requests: DataFrame, blocks: list[list[tuple[int, Scope]]], tables: SearchTables, cfg: EngineConfig) -> DataFrame:
    """The same for requests that bring their own filters and depth: (query_id, query, vector, scope_id, narrowing, candidates).

    Each block of scopes is one search: its vectors and the postings of its terms are scanned once for all its queries.
    The filters sit below the legs of every query, whatever compat_overfetch says.
    """
    hybrid = cfg.hybrid_search and tables.has_text
    deep = F.greatest(F.lit(cfg.hybrid_depth), "candidates", F.lit(1)) * F.when(F.col("narrowing"), leg_depth(1, 1, True)).otherwise(1)
    named = requests.withColumn("_depth", deep if hybrid else F.col("candidates"))
    answers = []
    for scopes in blocks:
        mine = named.filter(F.col("scope_id").isin([i for i, _ in scopes]))
        most = mine.agg(F.max("_depth").alias("depth"), F.max("candidates").alias("candidates")).first()
        if most["depth"] is None:
            continue
        vectors = accepting(tables.chunks.select("chunk_id", "path", "vector"), scopes, cfg)
        by_vector = nearest(mine, vectors, max(most["depth"], most["candidates"]))
        if not hybrid:
            found = by_vector.join(mine.select("query_id", "candidates"), "query_id").filter(F.col("ord") <= F.col("candidates"))
            answers.append(_by_vector_alone(found))
            continue
        worded = mine.filter(~is_blank())
        if tables.counted is not None:
            by_text = best_counted(worded, tables.counted, most["depth"], cfg.bm25_k1, cfg.bm25_b, scoped=accepting(tables.counted.rows, scopes, cfg))
        else:
            posted = accepting(tables.postings.select("chunk_id", "path", "term", "tf", "dl"), scopes, cfg)
            by_text = best_chunks(worded, posted, tables.stats, blocks_of(tables), most["depth"], cfg.bm25_k1, cfg.bm25_b, scoped=True)
        # Each leg as deep as its query says; then as many of the fused as it wants.
        asked = mine.select("query_id", is_blank().alias("_blank"), "_depth", "candidates")
        first = by_vector.join(asked.drop("candidates"), "query_id").filter(F.col("_blank") | (F.col("ord") <= F.col("_depth"))).drop("_depth")
        second = by_text.join(asked.select("query_id", "_depth"), "query_id").filter(F.col("ord") <= F.col("_depth")).drop("_depth")
        best = _blended(first, second, most["candidates"], cfg).join(asked.select("query_id", "candidates"), "query_id")
        answers.append(best.filter(F.col("ord") <= F.col("candidates")).select("query_id", "chunk_id", "score", "ord", "retrieval_mode"))
    if not answers:
        kind = tables.chunks.schema["chunk_id"].dataType.simpleString()
        return requests.sparkSession.createDataFrame([], f"query_id bigint, chunk_id {kind}, score double, ord int, retrieval_mode string")
    return reduce(DataFrame.unionByName, answers)


def blocks_of(tables: SearchTables) -> DataFrame:
    """The stored blocks, or blocks counted from the postings."""
    return term_blocks(tables.postings) if tables.blocks is None else tables.blocks


def _overfetched(queries: DataFrame, tables: SearchTables, scope: PathScope, limit: int, cfg: EngineConfig) -> DataFrame:
    """Filters after a widened search, so a filter can leave fewer than ``limit`` hits."""
    fetched = nearest(queries, tables.chunks, over_fetch(limit, scope.prefix is not None, scope.narrowing))
    located = fetched.withColumn("path", path_of_chunk(F.col("chunk_id")))
    kept = located if scope.predicate is None else located.filter(scope.predicate)
    scored = kept.select("query_id", "chunk_id", similarity(F.col("distance")).alias("score"), F.col("ord").alias("_at"))
    return best_per_query(scored, limit, F.col("_at")).drop("_at").withColumn("retrieval_mode", F.lit("vector"))


def path_of_chunk(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, r"#\d+\z", "")


def is_small_batch(queries: DataFrame) -> bool:
    """Few enough queries to broadcast their hits. Looks at the queries only."""
    return queries.select("query_id").limit(SMALL_BATCH + 1).count() <= SMALL_BATCH


def with_chunk_columns(found: DataFrame, tables: SearchTables, small: bool) -> DataFrame:
    """Looks the hits up in the chunk table, reading only the buckets they lie in; adds the index terms of the texts.

    ``found`` is read twice and should be a table. The hits of a small batch are broadcast: at most SMALL_BATCH x 100
    short rows, and the chunk table is not shuffled for them. Terms are made once per chunk, not per hit.
    """
    columns = ["chunk_id", "path", "start_line", "end_line", F.col("body").alias("text"), "definition_of"]
    keys = ["chunk_id"]
    if tables.path_buckets and "path_bucket" in tables.chunks.columns:
        columns.append("path_bucket")
        keys = ["path_bucket", "chunk_id"]
        found = found.withColumn("path_bucket", bucket_of(path_of_chunk(F.col("chunk_id")), tables.path_buckets))
    wanted = found.select(*keys).distinct()
    details = tables.chunks.select(*columns).join(F.broadcast(wanted) if small else wanted, keys, "left_semi")
    # The generator holds the terms; as a plain column they would be made anew above the join, for every hit.
    details = details.select("*", F.explode(F.array(F.array_distinct(index_terms(F.col("text"))))).alias("terms"))
    joined = details.join(F.broadcast(found) if small else found, keys)
    definition = F.nullif(trim(F.col("definition_of")), F.lit(""))
    return joined.withColumn("definition_of", definition).drop("path_bucket")


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def with_bodies(hits: DataFrame, tables: SearchTables, small: bool) -> DataFrame:
    """Adds the text to the hits that are left after ranking."""
    keys, columns = ["chunk_id"], ["chunk_id", F.col("body").alias("text")]
    if tables.path_buckets and "path_bucket" in tables.chunks.columns:
        keys, columns = ["path_bucket", "chunk_id"], [*columns, "path_bucket"]
        hits = hits.withColumn("path_bucket", bucket_of(F.col("path"), tables.path_buckets))
    return tables.chunks.select(*columns).join(F.broadcast(hits) if small else hits, keys).drop("path_bucket")


def search_plan(
    queries: DataFrame, tables: SearchTables, cfg: EngineConfig, request: SearchRequest,
    make_scorer: Callable[[], PairScorer] | None = None, small: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(query_id, query, query_classifier, vector) -> (hits, assessment).

    ``request`` gives the limit and the path filters of the whole batch.
    """
    candidates = max(request.limit, cfg.rerank_candidates)
    found = retrieve(queries, tables, path_scope(request, cfg), candidates, cfg)
    return _ranked(queries.withColumn("limit", F.lit(request.limit)), found, candidates, request.limit, tables, cfg, make_scorer, small)


def search_requests(
    requests: DataFrame, tables: SearchTables, cfg: EngineConfig, make_scorer: Callable[[], PairScorer] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Searches with filters of their own: (query_id, query, query_classifier, vector [, path_prefix, ext, lang, glob,
    include_docs, limit]) -> (hits, assessment, rejected). Rejected requests, (query_id, error), have neither."""
    if "limit" not in requests.columns:
        requests = requests.withColumn("limit", F.lit(SearchRequest("*").limit))
    named, blocks = compile_scopes(requests, cfg)
    faults = [
        F.when(F.coalesce(F.length("query"), F.lit(0)) < 1, "query must be a non-empty string"),
        F.when(~F.coalesce(F.col("limit").between(1, MAX_LIMIT), F.lit(False)), f"limit must be an integer between 1 and {MAX_LIMIT}"),
        F.when(~F.coalesce(F.col("query_classifier").isin(*QUERY_CLASSIFIERS), F.lit(False)), "unknown query_classifier"),
    ]
    named = written(named.withColumn("error", F.coalesce(*faults, "error")), "requests")
    good = named.filter("error IS NULL").withColumn("candidates", F.greatest("limit", F.lit(cfg.rerank_candidates)))
    found = retrieve_each(good, blocks, tables, cfg)
    hits, assessment = _ranked(good, found, max(MAX_LIMIT, cfg.rerank_candidates), MAX_LIMIT, tables, cfg, make_scorer, None)
    return hits, assessment, named.filter("error IS NOT NULL").select("query_id", "error")


def _ranked(
    queries: DataFrame, found: DataFrame, candidates: int, limit: int, tables: SearchTables, cfg: EngineConfig,
    make_scorer: Callable[[], PairScorer] | None, small: bool | None,
) -> tuple[DataFrame, DataFrame]:
    """Hits of each query up to its own limit, and their assessment. Texts are read where the chunks lie, for the features;
    what is ranked are numbers, and only final hits (or the pool of the pair model) get their text."""
    found = written(found, "hits")
    # Wide candidate lists of many queries are joined by shuffle instead.
    small = is_small_batch(queries) if small is None else small
    hits = with_chunk_columns(found, tables, small and candidates <= 200)
    features = query_features(queries, cfg)
    if cfg.rerank_enabled:
        ranked = rerank(hits, features, cfg)
    else:
        ranked = sort_by_focus(hits.drop("text", "terms"), features, cfg)
        if cfg.definition_boost_enabled and cfg.definition_boost > 0:
            ranked = sort_by_definition(ranked, features, cfg)
        ranked = ranked.withColumn("rerank_score", F.lit(None).cast("double"))
    ranked = ranked.withColumn("cross_encoder_logit", F.lit(None).cast("double"))
    small = small and limit <= 200
    if cfg.cross_encoder_enabled and make_scorer is not None:
        pool = ranked.filter(F.col("ord") <= max(limit, cfg.cross_encoder_top_k))
        top = cross_encode(with_bodies(pool, tables, small), queries, make_scorer, limit, cfg)
        top = _within_limit(top, queries)
    else:
        top = with_bodies(_within_limit(ranked.filter(F.col("ord") <= limit), queries), tables, small)
    # Hits and assessment both read it; it is made once.
    top = written(top.select(*HIT_COLUMNS, "retrieval_mode"), "top")
    return top, confidence.assess(queries, top, cfg)


def _within_limit(hits: DataFrame, queries: DataFrame) -> DataFrame:
    own = queries.select("query_id", F.col("limit").alias("_limit"))
    return hits.join(own, "query_id").filter(F.col("ord") <= F.col("_limit")).drop("_limit")


def snippet(text: Column) -> Column:
    return F.when(
        F.length(text) > MAX_SNIPPET_CHARS, F.concat(F.substr(text, F.lit(1), F.lit(MAX_SNIPPET_CHARS)), F.lit("…"))
    ).otherwise(text)


def hit_payload(hits: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The public columns of a hit; scores of the later stages only when debugging."""
    debug = ["rerank_score", "cross_encoder_logit"] if cfg.rerank_debug_scores else []
    return hits.select(
        "query_id", "ord", "path", "start_line", "end_line", "score", "definition_of", *debug, snippet(F.col("text")).alias("snippet")
    )


def result_json(hits: DataFrame, assessment: DataFrame, queries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One JSON document per query: hits in order, focus, confidence. Hit lists are at most 50 long."""
    payload = hit_payload(hits, cfg)
    fields = [c for c in payload.columns if c not in ("query_id", "ord")]
    lists = payload.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("_hits"))
    rows = queries.select("query_id", "query_classifier").join(lists, "query_id", "left")
    listed = F.coalesce(
        F.transform("_hits", lambda h: F.struct(*[h[f].alias(f) for f in fields])), F.array().cast(_hit_type(payload, fields))
    )
    columns = [listed.alias("hits"), F.col("query_classifier")]
    if cfg.match_confidence:
        rows = rows.join(assessment, "query_id", "left")
        columns += [F.col(c) for c in assessment.columns if c != "query_id"]
    return rows.select("query_id", F.to_json(F.struct(*columns), {"pretty": "true"}).alias("payload"))


def _hit_type(payload: DataFrame, fields: list[str]) -> str:
    return "array<struct<" + ",".join(f"{f}:{payload.schema[f].dataType.simpleString()}" for f in fields) + ">>"


def error_json(error: ConfigError) -> str:
    return json.dumps({"ok": False, "error": str(error)})


def queries_frame(spark, requests: Sequence[SearchRequest], cfg: EngineConfig) -> DataFrame:
    """Requests -> (query_id, query, query_classifier, vector)."""
    rows = []
    for number, request in enumerate(requests):
        check_request(request.query, request.limit)
        rows.append((number, request.query, resolve_classifier(request.query_classifier, request.search_focus)))
    frame = spark.createDataFrame(rows, "query_id bigint, query string, query_classifier string")
    return with_vectors(frame, cfg)


def with_vectors(queries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Queries are embedded as typed, without tags."""
    if "query_classifier" not in queries.columns:
        queries = queries.withColumn("query_classifier", F.lit("auto"))
    return queries.withColumn("vector", embed_column(F.col("query"), cfg))
