"""Approximate nearest neighbours by cosine over shifted space-filling curves.

Equal vectors are one item with its k + 1 smallest ids, all that can ever be asked of them; a very common vector costs no
more than a rare one. Every item gets a key on each of several Hilbert curves, made of its own random projection and grid
shift. Spark sorts the keys by range; a place in that order is a number, and `block` neighbours form a block. A query reads
the blocks within `window` places of its own on each curve used, scores what it finds exactly, in double precision, and the
curves' findings are merged.

How many curves and how wide a window are measured, not guessed: for about `sample` items the true neighbours are found by
comparing with all rows, in blocks, and the cheapest pair of curves and window is taken that finds `recall` of them. The less
structure vectors have, the more curves and the wider windows it takes; windows stay a part of the data unless it is tiny.

Defined cases: a null id, and a vector that is null, zero, holds null or non-finite parts or has another length than most
(the longer on ties), takes no part. Of rows that repeat an id the one with the least vector counts. With fewer than k
others, all are returned. An empty table gives an empty result, extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.llm.common import batch_of, narrow, shuffle_width
from seekspark.llm.hilbert import hilbert_keys, projection, to_cells
from seekspark.session import written


#: So many neighbouring blocks go to one task; findings that a task holds before it cuts them.
SPAN = 64
HELD = 1 << 18


@dataclass(frozen=True)
class CurveConfig:
    """curves: at most so many; dims and bits shape a key; sample: items the search is measured on (a bound of twice as many
    holds); recall: the share of their true neighbours that must be found there."""

    curves: int = 16
    dims: int = 8
    bits: int = 7
    block: int = 256
    sample: int = 256
    recall: float = 0.95
    seed: int = 17


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; extreme components are brought into range first."""
    top = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    vectors = vectors / np.where(top > 0, top, 1)
    return vectors / np.maximum(_norms(vectors)[:, None], 1e-300)


def _tamed(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares would leave the range of doubles, scaled by a power of two: angles stay, to the last bit."""
    exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))[1]
    extreme = np.abs(exponent) > 400
    return np.where(extreme[:, None], np.ldexp(vectors, -exponent[:, None]), vectors) if extreme.any() else vectors


def best(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, cosine) of the k nearest rows of every query, ties to the smaller id."""
    k = min(k, len(rows))
    out = []
    queries, rows = _tamed(queries), _tamed(rows)
    row_norms, row_units = _norms(rows), _scaled(rows)
    query_norms, query_units = _norms(queries), _scaled(queries)
    step = max(1, (4 << 20) // max(1, len(rows)))
    for at in range(0, len(queries), step):
        rough = query_units[at:at + step] @ row_units.T
        least = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        q, r = np.nonzero(rough >= least[:, None] - 1e-9)
        q += at
        score = (queries[q] * rows[r]).sum(axis=1) / (query_norms[q] * row_norms[r])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < k
        out.append((q[kept], ids[r[kept]], score[kept]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _valid(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part, ids unique, and their vectors' length."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").filter((F.size("v") > 0) & whole)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return rows, 0
    rows = rows.filter(F.size("v") == common["d"])
    ids = rows.groupBy("id").agg(F.count("*").alias("n"))
    if not ids.filter("n > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows, common["d"]


def _items(rows: DataFrame, k: int) -> DataFrame:
    """h, g, v, cid (least id), ids (the k + 1 smallest): one row per different vector. Ranks are cut before the shuffle."""
    own = Window.partitionBy("h", "g", "v").orderBy("id")
    few = rows.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k + 1)
    return few.groupBy("h", "g", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0])


def _placed(items: DataFrame, dim: int, config: CurveConfig) -> DataFrame:
    """curve, cid, place: where each item stands on each curve. Only keys and ids are sorted, not the vectors."""
    rng = np.random.default_rng(config.seed)
    shifts = rng.random((config.curves, config.dims))
    planes = [projection(config.seed + 1 + c, dim, config.dims) for c in range(config.curves)]
    spread = 1 / np.sqrt(max(dim, 1))
    out = pa.schema([("curve", pa.int32()), ("key", pa.int64()), ("cid", pa.int64())])

    def keyed(batches):
        for batch in batches:
            units = _scaled(_matrix(batch.column("v"), dim))
            for c in range(config.curves):
                keys = hilbert_keys(to_cells(units @ planes[c], spread, config.bits, shifts[c]), config.bits)
                yield batch_of(out, [np.full(len(keys), c, np.int32), keys, batch.column("cid")])

    numbered = pa.schema([("curve", pa.int32()), ("cid", pa.int64()), ("task", pa.int32()), ("n", pa.int64())])

    def number(batches):
        task, seen = TaskContext.get().partitionId(), dict.fromkeys(range(config.curves), 0)
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            n = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                own = np.flatnonzero(curve == c)
                n[own] = seen[c] + np.arange(len(own))
                seen[c] += len(own)
            yield batch_of(numbered, [curve, batch.column("cid"), np.full(len(curve), task, np.int32), n])

    ordered = (items.select("cid", "v").mapInArrow(keyed, "curve int, key long, cid long")
               .repartitionByRange(shuffle_width(items.sparkSession), "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid"))
    table = written(ordered.mapInArrow(number, "curve int, cid long, task int, n long"), "curve-order")
    # One row per (task, curve) in use.
    held = table.groupBy("curve", "task").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.join(held.select("curve", "task", before.alias("before")), ["curve", "task"]).select("curve", "cid", (F.col("before") + F.col("n")).alias("place"))


def _measured(items: DataFrame, places: DataFrame, n: int, dim: int, k: int, config: CurveConfig) -> tuple[int, int]:
    """(curves, window) to use, from the true neighbours of a bounded sample."""
    share = min(1.0, config.sample / n)
    chance = F.pmod(F.xxhash64(F.lit("curve-sample"), "cid"), F.lit(1 << 30)) / float(1 << 30)
    asked = items.filter(chance < share).select("cid", "v").limit(2 * config.sample).toPandas()
    if asked.empty:
        asked = items.select("cid", "v").limit(config.sample).toPandas()
    q_ids, queries = asked["cid"].to_numpy(np.int64), np.stack(asked["v"].to_list()).astype(np.float64)
    shared = items.sparkSession.sparkContext.broadcast((q_ids, queries))
    out = pa.schema([("q", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])

    def nearest(batches):
        q_ids, queries = shared.value
        held = None
        for batch in batches:
            q, r, s = best(queries, _matrix(batch.column("v"), dim), batch.column("cid").to_numpy(), k + 1)
            held = [np.concatenate(x) for x in zip(held, (q, r, s), strict=True)] if held else [q, r, s]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [x[order] for x in held]
            few = np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) <= k
            held = [x[few] for x in held]
        if held:
            yield batch_of(out, [q_ids[held[0]], held[1], held[2]])

    found = items.select("cid", "v").mapInArrow(nearest, "q long, cid long, score double").filter("q <> cid")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    truth = written(found.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k).select("q", "cid"), "curve-truth")
    at = places.select("curve", F.col("cid").alias("q"), F.col("place").alias("from"))
    gaps = truth.join(places, "cid").join(at, ["curve", "q"]).select("q", "cid", "curve", F.abs(F.col("place") - F.col("from")).alias("gap")).toPandas()
    if gaps.empty:
        return 1, n
    table = gaps.pivot(index=["q", "cid"], columns="curve", values="gap").to_numpy()
    choices = []
    for used in range(1, config.curves + 1):
        window = int(np.quantile(table[:, :used].min(axis=1), config.recall, method="higher")) + 1
        choices.append((used * (2 * window + config.block), used, window))
    return min(choices)[1:]


class _Found:
    """The k best different items of each query seen by a task."""

    def __init__(self, k: int):
        self.k, self.size = k, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, *found: np.ndarray) -> None:
        self.held.append(found)
        self.size += len(found[0])
        if self.size > HELD:
            self.held = [self.cut()]
            # What is left may be much for many queries: it is cut again when it has doubled.
            self.size = min(self.size // 2, len(self.held[0][0]))

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, r, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        fresh = np.r_[True, (np.diff(q) != 0) | (np.diff(r) != 0)]  # another curve may have found the same item
        q, r, s = q[fresh], r[fresh], s[fresh]
        few = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[few], r[few], s[few]


def search(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5,
           config: CurveConfig = CurveConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id satisfies `queries` (a condition on `id`)."""
    spark = rows.sparkSession
    valid, dim = _valid(narrow(rows, id=key, v=vector).select(F.col("id").cast("long").alias("id"), "v"))
    nothing = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], nothing)
    tagged = valid.select("id", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
    items = written(_items(tagged, k), "curve-items")
    n = items.count()
    places = written(_placed(items, dim, config), "curve-places")
    used, window = _measured(items, places, n, dim, k, config)
    asked = written(tagged.filter(queries).join(items.select("h", "g", "v", "cid"), ["h", "g", "v"]).select(F.col("id").alias("query_id"), "cid"), "curve-queries")

    in_use = places.filter(F.col("curve") < used)
    here = in_use.join(items.select("cid", "v"), "cid")
    block = F.floor(F.col("place") / config.block).cast("long")
    owners = here.select("curve", block.alias("block"), F.lit(0).alias("role"), "cid", "v")
    last = (n - 1) // config.block
    reach = F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("place") - window) / config.block)).cast("long"),
        F.least(F.lit(last), F.floor((F.col("place") + window) / config.block)).cast("long"))
    askers = here.join(asked.select("cid").distinct(), "cid").select("curve", F.explode(reach).alias("block"), F.lit(1).alias("role"), "cid", "v")
    out = pa.schema([("q", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])

    def scan(batches):
        """A block's owners come first and are held (at most `block`); its askers pass by. What an asker finds in the blocks of
        a span is merged before it goes on."""
        now, ids, vectors, found = None, [], [], _Found(k + 1)
        for batch in batches:
            head = np.column_stack([batch.column(c).to_numpy() for c in ("curve", "block", "role")])
            cids, v = batch.column("cid").to_numpy(), _matrix(batch.column("v"), dim)
            cuts = np.flatnonzero(np.r_[True, (np.diff(head, axis=0) != 0).any(axis=1)])
            for start, stop in zip(cuts, [*cuts[1:], len(head)], strict=True):
                curve, number, role = head[start]
                if (curve, number) != now:
                    now, ids, vectors = (curve, number), [], []
                if role == 0:
                    ids.append(cids[start:stop])
                    vectors.append(v[start:stop])
                    continue
                if not ids:
                    continue
                ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                q, r, s = best(v[start:stop], vectors[0], ids[0], k + 1)
                found.add(cids[start:stop][q], r, s)
        yield batch_of(out, list(found.cut()))

    met = (owners.unionByName(askers).repartition(shuffle_width(spark), F.col("curve"), F.floor(F.col("block") / SPAN))
           .sortWithinPartitions("curve", "block", "role").mapInArrow(scan, "q long, cid long, score double"))
    # Another curve may have found the same item; scores of a pair are always the same number.
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    merged = met.distinct().withColumn("r", rank).filter(F.col("r") <= k + 1)
    members = merged.join(items.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1)
    lists = members.groupBy("q").agg(nearest.alias("near"))
    own = asked.join(lists.withColumnRenamed("q", "cid"), "cid").select(
        "query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
