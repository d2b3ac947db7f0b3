"""Reciprocal rank fusion of the vector leg and the text leg."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.operators.topk import best_per_query


def leg_depth(hybrid_depth: int, limit: int, narrowing: bool) -> int:
    return max(hybrid_depth, limit, 1) * (4 if narrowing else 1)


def reciprocal_rank(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score) from two legs of (query_id, chunk_id, ord); ranks start at 1.

    Other columns of the first leg are kept, null where only the second leg found the chunk.
    """
    both = first.withColumnRenamed("ord", "_first").join(
        second.select("query_id", "chunk_id", F.col("ord").alias("_second")), ["query_id", "chunk_id"], "full_outer"
    )
    share = lambda rank: F.coalesce(1 / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", share("_first") + share("_second")).drop("_first", "_second")


def fuse(first: DataFrame, second: DataFrame, limit: int, k: int = 60) -> DataFrame:
    return best_per_query(reciprocal_rank(first, second, k), limit, F.col("score").desc(), F.col("chunk_id"))
