"""Reordering of bounded hit lists: heuristic rerank, focus and definition sorts, cross-encoder."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.config import EngineConfig
from seekspark.functions import paths, scoring, text
from seekspark.functions.intent import definition_target
from seekspark.operators.topk import renumber

log = logging.getLogger(__name__)
PairScorer = Callable[[Sequence[str], Sequence[str]], np.ndarray]


def query_features(queries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Everything the reranker needs to know of a query, computed once per query."""
    q = F.col("query")
    out = queries.select("query_id", "query", *(["query_classifier"] if "query_classifier" in queries.columns else []))
    if "query_classifier" not in out.columns:
        out = out.withColumn("query_classifier", F.lit("auto"))
    out = out.withColumn("tokens", text.query_tokens(q))
    target = definition_target(q) if cfg.definition_boost_enabled and cfg.definition_boost > 0 else F.lit(None).cast("string")
    return out.withColumns({
        "patterns": text.word_patterns(F.col("tokens")),
        "symbols": text.symbol_tokens(q, F.col("tokens")),
        "symbol_query": text.is_symbol_query(q, F.col("tokens")),
        "wants_tests": F.lit(cfg.test_path_boost) & text.mentions_tests(q),
        "wants_frontend": F.lit(cfg.frontend_path_boost) & text.mentions_frontend(q),
        "target": target,
    })


def hit_features(hits: DataFrame, features: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Hits (query_id, path, text, score, definition_of, ...) with the features of the formula.

    A column ``terms`` with the index terms of the text spares dividing the text for each of its queries.
    """
    known = F.col("terms") if "terms" in hits.columns else None
    low = hits.join(features, "query_id").withColumns({
        "_text": F.lower("text"), "_path": F.lower("path"),
    })
    body, path, tokens, patterns = (F.col(c) for c in ("_text", "_path", "tokens", "patterns"))
    return low.withColumns({
        "lexical": text.share_contained(tokens, body),
        "exact": text.share_whole_words(tokens, patterns, body, known),
        "exact_path": text.share_whole_words(tokens, patterns, path),
        "path_hint": text.share_contained(tokens, path),
        "symbol": text.share_contained_in_either(F.col("symbols"), body, path),
        "path_prior": scoring.code_path_prior(
            F.col("path"), F.col("symbol_query"), F.col("wants_tests"), F.col("wants_frontend"), F.col("query_classifier")
        ),
        "demotion": scoring.user_demotion(F.col("path"), cfg.demote_substrings, cfg.demote_per_match),
        "definition_prior": scoring.definition_prior(F.col("definition_of"), F.col("target"), cfg.definition_boost),
        "classifier_prior": scoring.classifier_prior(
            paths.content_bucket(F.col("path"), cfg.working_docs), F.col("query_classifier")
        ),
    }).drop("_text", "_path")


def with_rerank_score(featured: DataFrame) -> DataFrame:
    c = F.col
    prior = c("path_prior") + c("demotion") + c("definition_prior") + c("classifier_prior")
    return featured.withColumn("rerank_score", scoring.fused_score(
        c("symbol_query"), c("score"), c("lexical"), c("exact"), c("exact_path"), c("path_hint"), c("symbol"), prior
    ))


def rerank(hits: DataFrame, features: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Hits in their new order, without their texts; the retrieval order breaks ties."""
    kept = [c for c in hits.columns if c not in ("terms", "text")]
    scored = with_rerank_score(hit_features(hits, features, cfg)).select(*kept, "rerank_score")
    return renumber(scored, F.col("rerank_score").desc(), F.col("ord"))


def sort_by_focus(hits: DataFrame, features: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Order by score plus focus prior, for searches without the reranker."""
    joined = hits.join(features.select("query_id", "query_classifier"), "query_id")
    prior = scoring.classifier_prior(paths.content_bucket(F.col("path"), cfg.working_docs), F.col("query_classifier"))
    sort_key = joined.withColumn("_key", F.col("score") + prior)
    ordered = renumber(sort_key, F.col("_key").desc(), F.col("score").desc(), F.col("ord"), into="_new")
    keep = F.when(F.col("query_classifier") == "auto", F.col("ord")).otherwise(F.col("_new"))
    return ordered.withColumn("ord", keep).select(*hits.columns)


def sort_by_definition(hits: DataFrame, features: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Order by score plus definition bonus where the query names a symbol."""
    joined = hits.join(features.select("query_id", "target"), "query_id")
    bonus = scoring.definition_prior(F.col("definition_of"), F.col("target"), cfg.definition_boost)
    ordered = renumber(joined.withColumn("_key", F.col("score") + bonus), F.col("_key").desc(), F.col("ord"), into="_new")
    keep = F.when(F.col("target").isNull(), F.col("ord")).otherwise(F.col("_new"))
    return ordered.withColumn("ord", keep).select(*hits.columns)


def last_logits(logits: np.ndarray) -> np.ndarray:
    logits = np.asarray(logits)
    return logits if logits.ndim <= 1 else logits.reshape(len(logits), -1)[:, -1]


def cross_encode(
    hits: DataFrame, queries: DataFrame, make_scorer: Callable[[], PairScorer], limit: int, cfg: EngineConfig
) -> DataFrame:
    """Scores the pool of each query with a pair model and orders it by logit.

    The pool is cut before the model runs. If the model fails on a batch, its logits are null, and a
    query with a null logit keeps its heuristic order.
    """
    pool = hits.filter(F.col("ord") <= max(limit, cfg.cross_encoder_top_k))
    batch = cfg.cross_encoder_batch

    @F.pandas_udf(T.DoubleType())
    def logit(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = None
        for asked, passages in parts:
            out: list = []
            for at in range(0, len(asked), batch):
                q, p = asked[at : at + batch].tolist(), passages[at : at + batch].tolist()
                try:
                    scorer = scorer or make_scorer()
                    scores = np.asarray(scorer(q, p), dtype=float)
                    if len(scores) != len(q):
                        raise ValueError(f"{len(scores)} scores for {len(q)} pairs")
                    out.extend(scores.tolist())
                except Exception:  # noqa: BLE001 - any model failure falls back to the heuristic order
                    log.exception("cross-encoder failed; the heuristic order stays")
                    out.extend([None] * len(q))
            yield pd.Series(out, dtype="float64")

    joined = pool.drop("cross_encoder_logit").join(queries.select("query_id", "query"), "query_id")
    scored = joined.withColumn("_logit", logit(F.col("query"), F.col("text")))
    # A window, not a second aggregation joined back: the model must run once per pair.
    any_null = F.max(F.col("_logit").isNull().cast("int")).over(Window.partitionBy("query_id"))
    scored = scored.withColumn("_failed", any_null)
    finite = F.col("_logit").isNotNull() & ~F.isnan("_logit") & (F.abs("_logit") != float("inf"))
    usable = (F.col("_failed") == 0) & finite
    order = F.when(F.col("_failed") == 0, F.col("_logit"))
    ordered = renumber(scored, order.desc_nulls_last(), F.col("ord"), into="_new")
    columns = [c for c in hits.columns if c not in ("ord", "score", "cross_encoder_logit")]
    return ordered.select(
        *columns, F.col("_new").alias("ord"),
        F.when(usable, scoring.sigmoid(F.col("_logit"))).otherwise(F.col("score")).alias("score"),
        F.when(usable, F.col("_logit")).alias("cross_encoder_logit"),
    ).filter(F.col("ord") <= limit)
