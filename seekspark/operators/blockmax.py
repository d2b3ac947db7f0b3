"""The best chunks by BM25 without scoring every chunk that shares a word with the query.

The postings of a term fall into blocks by the level of dl / tf (powers of two); what a block can add to a score is bounded
by its greatest tf and least dl. A query is answered in three steps, all exact:

1. The blocks of the highest bounds, some multiples of k postings, give partial scores. The best chunks by them are scored
   whole; the k-th of these scores is a bar: k chunks reach it, so a chunk that cannot is no hit.
2. Terms whose bounds together stay below the bar cannot make a hit by themselves. Only postings of the others are read,
   and of these only blocks that can reach the bar along with all other terms. This is where common words drop out.
3. What is left of the candidates is completed with their postings of the common words.

Terms of a small batch are pushed to the scans, which are sorted by term. Postings go to the exchange once, dealt out by
chunk, and ranks are made in two steps. A batch that meets at most ONE_PASS postings, a number known from the blocks, is
scored in one pass instead, which costs less than three and gives the same. So does a sweep, which takes the batches that meet
many postings with queries and terms few enough to travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekspark.operators import words
from seekspark.operators.fulltext import MAX_BROADCAST_TERMS, SALTS, bm25, inverse_frequency, query_terms, term_score
from seekspark.operators.sweep import swept
from seekspark.operators.topk import best_per_query
from seekspark.session import written

LEVELS = 16
FIRST_POSTINGS = 8
ONE_PASS = 50_000_000
SWEEP_FROM = 1_000_000
# What a sweep sends to all tasks.
SWEEP_QUERIES = 2_048
SWEEP_TERMS = 100_000
# Each is a literal of the plan.
MAX_PUSHED_TERMS = 256
MAX_BROADCAST_CANDIDATES = 200_000
SHARES = 32
#: A task that counts terms puts its counts together after so many postings, and passes them on when there are as many.
ROWS = 1 << 21
# Sums of doubles in another order differ in the last digits; a bar that far below its value loses no hit.
SLACK = 1e-9


def level(tf: Column, dl: Column) -> Column:
    """The power of two of dl / tf."""
    return F.least(F.floor(F.log2(dl / tf)), F.lit(LEVELS - 1)).cast("int")


def term_blocks(posted: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, level, df, max_tf, min_dl); df adds up over the levels of a term."""
    return posted.groupBy(*keys, "term", level(F.col("tf"), F.col("dl")).alias("level")).agg(
        F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def term_counts(posted: DataFrame, *keys: str) -> DataFrame:
    """The same counted by each task alone, without an exchange: a block may have several rows, which `added` puts together."""
    columns = [*keys, "term", "level"]
    rows = posted.select(*keys, "term", level(F.col("tf"), F.col("dl")).alias("level"), "tf", "dl")

    def counted(found: pa.Table, df: tuple[str, str], tf: str, dl: str) -> pa.Table:
        made = found.group_by(columns).aggregate([df, (tf, "max"), (dl, "min")])
        return pa.table([*(made.column(c) for c in columns), made.column("_".join(df)), made.column(f"{tf}_max"), made.column(f"{dl}_min")],
                        names=[*columns, "df", "max_tf", "min_dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        parts: list[pa.Table] = []

        def cut() -> None:
            if held:
                parts.append(counted(pa.Table.from_batches(held), ("tf", "count"), "tf", "dl"))
                held.clear()

        def merged() -> Iterator[pa.RecordBatch]:
            cut()
            if parts:
                parts[:] = [counted(pa.concat_tables(parts), ("df", "sum"), "max_tf", "min_dl")]
            if parts and len(parts[0]) >= ROWS:
                yield from parts.pop().to_batches(1 << 14)

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting % ROWS < batch.num_rows:
                yield from merged()
            elif sum(b.num_rows for b in held) >= 1 << 17:
                cut()
        yield from merged()
        if parts:
            yield from parts.pop().to_batches(1 << 14)

    kinds = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    return rows.mapInArrow(run, f"{kinds + ', ' if kinds else ''}term string, level int, df bigint, max_tf bigint, min_dl bigint")


def level_of(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """`level` of numbers at hand, by the same quotient of logarithms."""
    return np.minimum(np.floor(np.log(dl / tf) / np.log(2.0)), LEVELS - 1).astype(np.int32)


def text_counts(chunks: DataFrame, text: Column, *keys: str) -> DataFrame:
    """The blocks of the postings of texts, counted by each task alone, without an exchange and without a row for a posting:
    a block may have several rows, which `added` puts together. What a task passes on at a time is sorted by keys and term."""
    columns = [*keys, "term", "level"]
    rows = chunks.select(*keys, F.lower(text).alias("_text"))

    def ordered(made: pa.Table) -> pa.Table:
        return made.take(pc.sort_indices(made, sort_keys=[(c, "ascending") for c in columns]))

    def merged(parts: list[pa.Table]) -> pa.Table:
        made = pa.concat_tables(parts).group_by(columns).aggregate([("df", "sum"), ("max_tf", "max"), ("min_dl", "min")])
        return pa.table([*(made.column(c) for c in columns), made.column("df_sum"), made.column("max_tf_max"), made.column("min_dl_min")],
                        names=[*columns, "df", "max_tf", "min_dl"])

    def counted(batch: pa.RecordBatch) -> pa.Table:
        """The blocks of a few texts with the same keys."""
        found, lengths = words.terms_of(batch.column("_text"))
        terms = found.dictionary_encode()
        kinds = max(1, len(terms.dictionary))
        pairs, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * kinds + terms.indices.to_numpy(), return_counts=True)
        dl = lengths[pairs // kinds]
        block, at, df = np.unique(pairs % kinds * LEVELS + level_of(tf, dl), return_inverse=True, return_counts=True)
        max_tf, min_dl = np.zeros(len(block), np.int64), np.full(len(block), np.iinfo(np.int64).max)
        np.maximum.at(max_tf, at, tf)
        np.minimum.at(min_dl, at, dl)
        return pa.table([*(pa.repeat(batch.column(key)[0], len(block)) for key in keys), terms.dictionary.take(pa.array(block // LEVELS)),
                         pa.array(block % LEVELS, pa.int32()), pa.array(df), pa.array(max_tf), pa.array(min_dl)], names=[*columns, "df", "max_tf", "min_dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = last = 0
        for batch in batches:
            heads = np.zeros(batch.num_rows, bool)
            for key in keys:
                column = batch.column(key)
                heads[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(heads)
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                same = batch.slice(low, high - low)
                for at, stop in words.pieces(same.column("_text")):
                    parts.append(counted(same.slice(at, stop - at)))
                    held += len(parts[-1])
            # Put together when there are twice as many as after the last time.
            if held >= max(ROWS // 8, 2 * last):
                parts = [merged(parts)]
                held = last = len(parts[0])
                if held >= ROWS:
                    yield from ordered(parts.pop()).to_batches(1 << 14)
                    held = last = 0
        if parts:
            yield from ordered(merged(parts)).to_batches(1 << 14)

    kinds = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    return rows.mapInArrow(run, f"{kinds + ', ' if kinds else ''}term string, level int, df bigint, max_tf bigint, min_dl bigint")


def added(counts: DataFrame, *keys: str) -> DataFrame:
    """The blocks of several counts of them."""
    return counts.groupBy(*keys, "term", "level").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


def query_blocks(queries: DataFrame, blocks: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id [, scope_id], term, level, weight, n, bound): the blocks a query meets and what each can add at most."""
    n_docs, avg_dl = (stats.select(c).scalar() for c in ("n_docs", "avg_dl"))
    asked = query_terms(queries)
    held = blocks.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = F.sum("df").over(Window.partitionBy("term"))
    known = held.select("term", "level", F.col("df").alias("n"), "max_tf", "min_dl", df.alias("_df"))
    weight = F.col("qtf") * inverse_frequency(F.col("_df"), n_docs)
    most = term_score(F.col("max_tf"), F.col("min_dl"), avg_dl, k1, b)
    scope = ["scope_id"] if "scope_id" in queries.columns else []
    met = asked.join(known, "term").select("query_id", "term", "level", weight.alias("weight"), "n", (weight * most).alias("bound"))
    return met.join(queries.select("query_id", *scope), "query_id") if scope else met


def first_blocks(met: DataFrame, k: int) -> DataFrame:
    """The blocks of the highest bounds of each query, until they hold some multiples of k postings."""
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "term", "level")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < FIRST_POSTINGS * k).drop("_before")


def with_roles(met: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds `essential` and `rest` (what the terms that are not essential can add together), and drops the blocks below the bar.

    A block of an essential term goes if it stays below the bar along with the best of all other terms.
    """
    tops = met.groupBy("query_id", "term").agg(F.max("bound").alias("_top"))
    upwards = Window.partitionBy("query_id").orderBy("_top", "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query_id")
    tops = tops.join(bars, "query_id", "left").withColumn("_bar", F.coalesce("bar", F.lit(0.0)))
    tops = tops.withColumn("essential", F.sum("_top").over(upwards) >= F.col("_bar"))
    tops = tops.withColumns({"_all": F.sum("_top").over(whole), "rest": F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("_top"))).over(whole)})
    roles = met.join(tops.select("query_id", "term", "_top", "_all", "_bar", "essential", "rest"), ["query_id", "term"])
    reaches = F.col("bound") + F.col("_all") - F.col("_top") >= F.col("_bar")
    return roles.filter(~F.col("essential") | reaches).withColumnRenamed("_bar", "bar").drop("_top", "_all")


class _Postings:
    """The postings of a batch: which of them match blocks, and what they add."""

    def __init__(self, pool: DataFrame, stats: DataFrame, k1: float, b: float, scoped: bool):
        self.pool, self.scoped = pool, scoped
        avg_dl = stats.select("avg_dl").scalar()
        self.gain = F.col("weight") * term_score(F.col("tf"), F.col("dl"), avg_dl, k1, b)

    def of(self, blocks: DataFrame, dealt: bool = False, within: DataFrame | None = None) -> DataFrame:
        """(blocks' columns, chunk_id, tf, dl): the postings in the blocks. within: chunks to which they are restricted."""
        pool = self.pool
        terms = [r["term"] for r in blocks.select("term").distinct().limit(MAX_PUSHED_TERMS + 1).collect()]
        if len(terms) <= MAX_PUSHED_TERMS:
            pool = pool.filter(F.col("term").isin(terms))
        pool = pool.withColumn("level", level(F.col("tf"), F.col("dl")))
        few = blocks.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS
        if few:
            pool = pool.join(F.broadcast(blocks.select("term", "level").distinct()), ["term", "level"], "left_semi")
        if within is not None:
            pool = pool.join(within, "chunk_id", "left_semi")
        if few:
            pool = pool.repartition("chunk_id") if dealt else pool
            matched = pool.join(F.broadcast(blocks), ["term", "level"])
        else:
            salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")
            spread = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            matched = pool.withColumn("_salt", salt).join(spread, ["term", "level", "_salt"]).drop("_salt")
        return matched.filter(F.array_contains("scopes", F.col("scope_id"))) if self.scoped else matched


def best_chunks(
    queries: DataFrame, posted: DataFrame, stats: DataFrame, blocks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75,
    allowed: Column | None = None, scoped: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, score, ord): the k best chunks of each query, as scoring every chunk would give them.

    blocks: (term, level, df, max_tf, min_dl) of the whole corpus, whose statistics hold whatever `allowed` leaves. scoped:
    the postings have the array of `scopes` that accept them, the queries a scope_id.
    """
    frequencies = blocks.groupBy("term").agg(F.sum("df").alias("df"))
    size = query_terms(queries).join(frequencies, "term", "left").agg(
        F.count("*").alias("terms"), F.count_distinct("query_id").alias("queries"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    if size["postings"] > SWEEP_FROM and size["queries"] <= SWEEP_QUERIES and size["terms"] <= min(SWEEP_TERMS, MAX_BROADCAST_TERMS):
        scored = _swept(queries, posted, stats, frequencies, k, k1, b, allowed, scoped)
        return best_per_query(scored, k, F.col("score").desc(), F.col("chunk_id"), shares=SHARES)
    if size["postings"] <= ONE_PASS:
        few = size["terms"] <= MAX_BROADCAST_TERMS
        scored = bm25(queries, posted, stats, k1, b, allowed, few, frequencies, scoped)
        return best_per_query(scored, k, F.col("score").desc(), F.col("chunk_id"), shares=SHARES)
    pool = posted if allowed is None else posted.filter(allowed)
    source = _Postings(pool.select("chunk_id", "term", "tf", "dl", *(["scopes"] if scoped else [])), stats, k1, b, scoped)
    met = written(query_blocks(queries, blocks, stats, k1, b), "query-blocks")
    bars = _bars(source, met, k)
    roles = written(with_roles(met, bars), "block-roles")
    scores = source.of(roles.filter("essential"), dealt=True).groupBy("query_id", "chunk_id").agg(
        F.sum(source.gain).alias("score"), F.first("rest").alias("_rest"), F.first("bar").alias("_bar"))
    able = written(scores.filter(F.col("score") + F.col("_rest") >= F.col("_bar")).select("query_id", "chunk_id", "score"), "candidates")
    chunks = able.select("chunk_id").distinct()
    small = chunks.limit(MAX_BROADCAST_CANDIDATES + 1).count() <= MAX_BROADCAST_CANDIDATES
    common = source.of(roles.filter("NOT essential"), within=F.broadcast(chunks) if small else chunks)
    added = common.select("query_id", "chunk_id", source.gain.alias("score"))
    # Candidates only: a pair that just shares common words has no row in `able`.
    pairs = able.select("query_id", "chunk_id")
    few_pairs = pairs.limit(MAX_BROADCAST_CANDIDATES + 1).count() <= MAX_BROADCAST_CANDIDATES
    added = added.join(F.broadcast(pairs) if few_pairs else pairs, ["query_id", "chunk_id"], "left_semi")
    total = able.unionByName(added).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return best_per_query(total, k, F.col("score").desc(), F.col("chunk_id"), shares=SHARES)


def _swept(
    queries: DataFrame, posted: DataFrame, stats: DataFrame, frequencies: DataFrame, k: int, k1: float, b: float, allowed: Column | None, scoped: bool,
) -> DataFrame:
    """(query_id, chunk_id, score): the best chunks of each task."""
    totals = stats.select("n_docs", "avg_dl").first()
    weight = F.col("qtf") * inverse_frequency(F.col("df"), F.lit(totals["n_docs"]))
    weighted = query_terms(queries).join(frequencies, "term").select("query_id", "term", weight.alias("weight"))
    if scoped:
        weighted = weighted.join(queries.select("query_id", "scope_id"), "query_id")
    asked = weighted.toArrow()
    pool = (posted if allowed is None else posted.filter(allowed)).select("chunk_id", "term", "tf", "dl", *(["scopes"] if scoped else []))
    terms = set(asked.column("term").to_pylist())
    if len(terms) <= MAX_PUSHED_TERMS:
        pool = pool.filter(F.col("term").isin(*terms))
    gain = term_score(F.col("tf"), F.col("dl"), F.lit(totals["avg_dl"]), k1, b)
    # Rounding makes chunks of equal text tie, as in `bm25`.
    return swept(asked, pool, gain, k).withColumn("score", F.round("score", 9))


def _bars(source: _Postings, met: DataFrame, k: int) -> DataFrame:
    """(query_id, bar): the k-th best whole score among chunks that look good at first; no row where there are fewer."""
    partial = source.of(first_blocks(met, k)).groupBy("query_id", "chunk_id").agg(F.sum(source.gain).alias("score"))
    best = best_per_query(partial, 2 * k, F.col("score").desc(), F.col("chunk_id"), shares=SHARES)
    pairs = written(best.select("query_id", "chunk_id"), "first-chunks")
    small = pairs.limit(MAX_BROADCAST_CANDIDATES + 1).count() <= MAX_BROADCAST_CANDIDATES
    sent = F.broadcast if small else (lambda frame: frame)
    whole = source.of(met, within=sent(pairs.select("chunk_id").distinct())).join(sent(pairs), ["query_id", "chunk_id"], "left_semi")
    scores = whole.groupBy("query_id", "chunk_id").agg(F.sum(source.gain).alias("score"))
    reached = best_per_query(scores, k, F.col("score").desc(), F.col("chunk_id"))
    return reached.filter(F.col("ord") == k).select("query_id", (F.col("score") * (1 - SLACK) - SLACK).alias("bar"))
