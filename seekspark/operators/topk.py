"""Per-query ranks and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_query(scored: DataFrame, k: int, *order: Column, rank: str = "ord", shares: int = 1) -> DataFrame:
    """The first k rows of each query by ``order``, numbered from 1.

    Filtering on the row number lets the planner keep only k rows per query and task before the shuffle. With ``shares``
    each query's rows are first cut in so many shares of its chunks, of which none holds them all.
    """
    if shares > 1:
        share = F.pmod(F.xxhash64("chunk_id"), F.lit(shares))
        within = Window.partitionBy("query_id", "_share").orderBy(*order)
        cut = scored.withColumn("_share", share).withColumn("_within", F.row_number().over(within))
        scored = cut.filter(F.col("_within") <= k).drop("_share", "_within")
    over = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(over)).filter(F.col(rank) <= k)


def renumber(hits: DataFrame, *order: Column, into: str = "ord") -> DataFrame:
    """Numbers already bounded hit lists anew in another order."""
    return hits.withColumn(into, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
