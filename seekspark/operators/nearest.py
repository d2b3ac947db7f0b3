"""Exact nearest neighbours by squared Euclidean distance.

Queries come in blocks. A task holds one block of query vectors, scans its share of the vectors once and passes on its k
best per query, so what is ranked afterwards are tasks x queries x k short rows, never vectors. One block travels with the
tasks and the vectors are not shuffled; more blocks are dealt out together with the vectors, all in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.operators.topk import best_per_query

# A block of query vectors is held by a task: about 1,024 x 768 doubles, 6 MB.
QUERY_BLOCK = 1_024
_OUT = "query_id bigint, chunk_id {kind}, distance double"


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def over_fetch(limit: int, prefix: bool, narrowing: bool) -> int:
    """How many neighbours to ask for when filters come after the search."""
    if narrowing:
        return max(limit * 20, 100)
    return limit * 8 if prefix else limit


def matrix_of(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; unequal lengths are an error, a distance between them has no meaning."""
    lengths = np.unique(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of unequal length: {lengths[:5].tolist()}")
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(lists), -1)


_NOTHING = np.zeros(0, np.int64)


def _members(lists: pa.Array) -> dict[int, np.ndarray]:
    """For each value the positions of the lists that hold it."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    parents = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    order = np.argsort(values, kind="stable")
    different, starts = np.unique(values[order], return_index=True)
    return dict(zip(different.tolist(), np.split(parents[order], starts[1:]), strict=True)) if len(values) else {}


class _Block:
    """The k nearest rows seen so far of every query of a block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, scopes: np.ndarray | None = None) -> None:
        self.ids, self.matrix, self.k, self.scopes = ids, matrix, k, scopes
        self.norms = (matrix * matrix).sum(axis=1)
        self.kept: list[list] = [[] for _ in ids]
        self.limits = np.full(len(ids), np.inf)

    def see(self, names: pa.Array, vectors: np.ndarray, allowed: pa.Array | None = None) -> None:
        """allowed: for each vector the scopes that accept it, where the queries of the block have scopes."""
        if vectors.shape[1] != self.matrix.shape[1]:
            raise ValueError(f"vectors of length {vectors.shape[1]} against queries of length {self.matrix.shape[1]}")
        squares = (vectors * vectors).sum(axis=1)
        # |v|^2 + |q|^2 - 2 v.q picks candidates; their distances are then computed directly. Its rounding error grows
        # with the norms, not with the distance, and so does the slack.
        rough = self.norms[:, None] + squares[None, :] - 2.0 * (self.matrix @ vectors.T)
        slack = 1e-15 * (8 + vectors.shape[1]) * (self.norms[:, None] + squares[None, :])
        members = {} if self.scopes is None else _members(allowed)
        for row in range(len(self.ids)):
            low, high = rough[row] - slack[row], rough[row] + slack[row]
            within = None
            if self.scopes is not None:
                within = members.get(int(self.scopes[row]), _NOTHING)
                low, high = low[within], high[within]
            bar = self.limits[row]
            if len(high) > self.k:
                bar = min(bar, np.partition(high, self.k - 1)[self.k - 1])
            near = np.flatnonzero(low <= bar) if np.isfinite(bar) else np.arange(len(low))
            if not len(near):
                continue
            near = near if within is None else within[near]
            gap = vectors[near] - self.matrix[row]
            exact = (gap * gap).sum(axis=1)
            # Only what can still be among the k nearest is named; ties stay, the names decide them.
            last = min(self.limits[row], np.partition(exact, self.k - 1)[self.k - 1] if len(exact) > self.k else np.inf)
            kept = np.flatnonzero(~(exact > last))
            self.kept[row].extend(zip(exact[kept].tolist(), names.take(pa.array(near[kept])).to_pylist(), strict=True))
            self.kept[row] = sorted(self.kept[row])[:self.k]
            if len(self.kept[row]) == self.k:
                self.limits[row] = self.kept[row][-1][0]

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = [(int(q), name, distance) for q, found in zip(self.ids, self.kept, strict=True) for distance, name in found]
        if rows:
            queries, names, distances = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries, pa.int64()), pa.array(names, kind), pa.array(distances, pa.float64())],
                names=["query_id", "chunk_id", "distance"],
            )


def _one_block(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, scopes: np.ndarray | None) -> DataFrame:
    kind = vectors.schema["chunk_id"].dataType.simpleString()
    columns = ["chunk_id", "vector"] + ([] if scopes is None else ["scopes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names = _Block(ids, matrix, k, scopes), None
        for batch in batches:
            if batch.num_rows:
                names = batch.column(0)
                block.see(names, matrix_of(batch.column(1)), None if scopes is None else batch.column(2))
        if names is not None:
            yield from block.rows(names.type)

    return vectors.select(*columns).mapInArrow(run, _OUT.format(kind=kind))


def _many_blocks(queries: DataFrame, vectors: DataFrame, blocks: int, k: int, scoped: bool) -> DataFrame:
    """Every block meets every share of the vectors: the queries against all rows, in blocks, as one job."""
    spark = vectors.sparkSession
    kind = vectors.schema["chunk_id"].dataType.simpleString()
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    none = F.lit(None).cast("array<int>")
    asked = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(shares, "share"), F.lit(0).alias("role"),
        "query_id", F.lit(None).cast(kind).alias("chunk_id"), "vector", (F.array("scope_id") if scoped else none).alias("scopes"))
    held = vectors.select(
        every(blocks, "block"), F.pmod(F.xxhash64("chunk_id"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("role"),
        F.lit(None).cast("bigint").alias("query_id"), "chunk_id", "vector", (F.col("scopes") if scoped else none).alias("scopes"))
    dealt = asked.unionByName(held).repartition(shares, "block", "share").sortWithinPartitions("block", "share", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, ids, rows, within, names = None, None, [], [], [], None
        for batch in batches:
            head = np.column_stack([batch.column(c).to_numpy() for c in ("block", "share", "role")])
            cuts = np.flatnonzero(np.r_[True, (np.diff(head, axis=0) != 0).any(axis=1)])
            for start, stop in zip(cuts, [*cuts[1:], len(head)], strict=True):
                part = batch.slice(start, stop - start)
                if tuple(head[start, :2]) != now:
                    if block is not None:
                        yield from block.rows(names.type)
                    now, block, ids, rows, within = tuple(head[start, :2]), None, [], [], []
                if head[start, 2] == 0:
                    ids.append(part.column("query_id").to_numpy())
                    rows.append(matrix_of(part.column("vector")))
                    if scoped:
                        within.append(part.column("scopes").flatten().to_numpy(zero_copy_only=False))
                    continue
                names = part.column("chunk_id")
                if block is None and ids:
                    block = _Block(np.concatenate(ids), np.concatenate(rows), k, np.concatenate(within) if scoped else None)
                if block is not None:
                    block.see(names, matrix_of(part.column("vector")), part.column("scopes") if scoped else None)
        if block is not None:
            yield from block.rows(names.type)

    return dealt.mapInArrow(run, _OUT.format(kind=kind))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, distance, ord): the k nearest (chunk_id, vector) of each (query_id, vector).

    Where the queries have a scope_id and the vectors the array of scopes that accept them, a query sees only the vectors
    that its scope accepts. The number of queries is counted first. Up to one block of them reaches the driver, as the
    block that travels.
    """
    vectors = vectors.filter(F.col("vector").isNotNull())
    scoped = "scope_id" in queries.columns and "scopes" in vectors.columns
    wanted = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector", *(["scope_id"] if scoped else []))
    blocks = -(-wanted.count() // QUERY_BLOCK)
    if blocks > 1:
        found = _many_blocks(wanted, vectors, blocks, k, scoped)
    elif blocks:
        head = wanted.collect()
        ids, matrix = np.array([r.query_id for r in head], dtype=np.int64), np.array([r.vector for r in head], dtype=np.float64)
        found = _one_block(vectors, ids, matrix, k, np.array([r.scope_id for r in head], dtype=np.int64) if scoped else None)
    else:
        found = vectors.limit(0).select(F.lit(0).cast("bigint").alias("query_id"), "chunk_id", F.lit(0.0).alias("distance"))
    # Ranked in two steps, so that the lists of many tasks for one query do not meet in one.
    return best_per_query(found, k, F.col("distance"), F.col("chunk_id"), shares=64)
