"""How far the top of a result list can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.functions.paths import path_family
from seekspark.functions.text import SPACE, trim

HINTS = {
    "low": "Nothing in the index matches this query strongly; treat the hits as guesses.",
    "possible_ambiguous_literal_query": "The query is a bare name: the best hit may be another thing of that name.",
    "top_hits_different_path_families": "The two best hits come from different kinds of files; check which one is meant.",
    "medium": "The first hits are plausible but not clearly ahead; read them before relying on them.",
    "high": "The first hit stands out; a look at the file is still advised.",
}


def is_ambiguous_literal(query: Column) -> Column:
    """A single identifier, or an article and one."""
    q = trim(query)
    name = r"[A-Za-z_][A-Za-z0-9_]*\z"
    return F.length(q).between(2, 64) & (q.rlike("^" + name) | q.rlike(f"(?i)^(?:the|an?){SPACE}+{name}"))


def relative_separation(first: Column, second: Column) -> Column:
    """(first - second) / |first|; 1 when there is no second."""
    return F.when(second.isNull(), 1.0).otherwise((first - second) / F.greatest(F.abs(first), F.lit(1e-9)))


def families_diverge(first_path: Column, second_path: Column) -> Column:
    a, b = path_family(first_path), path_family(second_path)
    return F.coalesce(second_path.isNotNull() & (a != "other") & (b != "other") & (a != b), F.lit(False))


def top_two(hits: DataFrame, rerank_enabled: bool) -> DataFrame:
    """One row per query with the primary score and path of its first two hits."""
    primary = F.col("score")
    if rerank_enabled and "rerank_score" in hits.columns:
        finite = F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (
            F.abs("rerank_score") != float("inf")
        )
        primary = F.when(finite, F.col("rerank_score")).otherwise(F.col("score"))
    at = lambda rank, value: F.max(F.when(F.col("ord") == rank, value))
    return hits.filter(F.col("ord") <= 2).groupBy("query_id").agg(
        at(1, primary).alias("t0"), at(2, primary).alias("t1"),
        at(1, F.col("path")).alias("p0"), at(2, F.col("path")).alias("p1"),
    )


def assess(queries: DataFrame, hits: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(query_id, query) and their ordered hits -> one assessment per query, also without hits."""
    top = queries.select("query_id", "query").join(top_two(hits, cfg.rerank_enabled), "query_id", "left")
    t0, t1 = F.col("t0"), F.col("t1")
    top = top.withColumn("separation", relative_separation(t0, t1))
    tight = t1.isNotNull() & (F.col("separation") < cfg.min_gap)
    tight_reason = F.when(tight, F.lit("tight_top_scores"))
    downgrades = F.array_compact(F.array(
        F.when(F.lit(cfg.ambiguous_literal_downgrade) & is_ambiguous_literal(F.col("query")),
               F.lit("possible_ambiguous_literal_query")),
        F.when(F.lit(cfg.path_family_divergence) & families_diverge(F.col("p0"), F.col("p1")),
               F.lit("top_hits_different_path_families")),
    ))
    strong = t0 >= cfg.strong_above
    reasons = (
        F.when(t0.isNull(), F.array(F.lit("no_hits")))
        .when(t0 < cfg.weak_below, F.array_compact(F.array(tight_reason, F.lit("low_primary_score"))))
        .when(strong & ~tight, F.concat(downgrades, F.array(F.lit("strong_top_and_separation"))))
        .when(strong, F.array(F.lit("strong_score_but_tight_top"), F.lit("tight_top_scores")))
        .when(tight, F.array(F.lit("tight_top_scores")))
        .otherwise(F.array(F.lit("below_strong_threshold")))
    )
    level = (
        F.when(t0.isNull() | (t0 < cfg.weak_below), "low")
        .when(strong & ~tight & (F.size(downgrades) == 0), "high")
        .otherwise("medium")
    )
    return top.select(
        "query_id",
        level.alias("match_confidence"),
        reasons.alias("match_confidence_reasons"),
        t0.alias("top_primary_score"),
        F.when(t1.isNotNull(), F.col("separation")).alias("top_relative_separation"),
    ).withColumn("match_confidence_hint", hint(F.col("match_confidence"), F.col("match_confidence_reasons")))


def hint(level: Column, reasons: Column) -> Column:
    special = ("possible_ambiguous_literal_query", "top_hits_different_path_families")
    out = F.when(level == "low", HINTS["low"]).when(level == "high", HINTS["high"])
    for reason in special:
        out = out.when(F.array_contains(reasons, reason), HINTS[reason])
    return out.otherwise(HINTS["medium"])
