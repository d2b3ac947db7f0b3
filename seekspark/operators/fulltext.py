"""BM25 over a postings table.

Postings are one row per (chunk, term), made inside the chunk's row without a shuffle. A term every chunk holds is a large
group, so nothing here ever gathers the rows of one term: counts are partially aggregated, and the join that fans query
terms out over their postings is a broadcast of the query side, or salted when that side is large. The postings of the
query terms are dealt out by chunk before the join, so the scores of a (query, chunk) pair meet where they arise and
only the best of each task go further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.functions.text import index_terms
from seekspark.operators import words

MAX_BROADCAST_TERMS = 200_000
SALTS = 32
# Terms counted at a time, roughly: texts are taken by their bytes.
TERMS = 1 << 18
BYTES_A_TERM = 8
#: Terms sorted together, roughly, and postings handed on at a time.
RUN = 1 << 20
PASSED_ON = 1 << 16


def postings(chunks: DataFrame, text: Column, keys: tuple[str, ...] = ("chunk_id",), runs_of: str | None = None) -> DataFrame:
    """(keys, term, tf, dl) of every chunk; dl counts all terms of the chunk.

    The terms of a row are counted where they are made, those of some texts at a time. ``runs_of``: one of the keys; postings
    come in long runs of one value of it, each sorted by term, so that a table of them needs no sort of its own.
    """
    rows = chunks.select(*keys, F.lower(text).alias("_text"))
    size = (RUN if runs_of else TERMS) * BYTES_A_TERM

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, lengths = words.terms_of(batch.column("_text"))
        terms = found.dictionary_encode()
        names, code, row = terms.dictionary, terms.indices.to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
        if runs_of:
            order = pc.sort_indices(names)
            rank = np.empty(len(names), np.int64)
            rank[order.to_numpy()] = np.arange(len(names))
            names, rows_each = names.take(order), max(1, len(lengths))
            pairs, tf = np.unique(rank[code] * rows_each + row, return_counts=True)
            code, row = pairs // rows_each, pairs % rows_each
        else:
            kinds = max(1, len(names))
            pairs, tf = np.unique(row * kinds + code, return_counts=True)
            row, code = pairs // kinds, pairs % kinds
        for at in range(0, max(1, len(row)), PASSED_ON):
            mine, said = row[at:at + PASSED_ON], code[at:at + PASSED_ON]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(key).take(pa.array(mine)) for key in keys), names.take(pa.array(said)),
                 pa.array(lengths[mine]), pa.array(tf[at:at + PASSED_ON].astype(np.int64))], names=[*keys, "term", "dl", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "_text", runs_of, size) if runs_of else batches:
            for at, stop in words.pieces(batch.column("_text"), size):
                yield from counted(batch.slice(at, stop - at))

    kinds = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    return rows.mapInArrow(run, f"{kinds}, term string, dl bigint, tf bigint")


def gathered(batches: Iterator[pa.RecordBatch], text: str, key: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of one value of the key and of about so many bytes of text, or as many as come one after the other."""
    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        heads = np.flatnonzero(pc.not_equal(batch.column(key)[1:], batch.column(key)[:-1]).to_numpy(zero_copy_only=False)) + 1
        for low, high in zip([0, *heads], [*heads, batch.num_rows], strict=True):
            part = batch.slice(low, high - low)
            if not part.num_rows:
                continue
            if held and (waiting + part.column(text).nbytes > size or held[0].column(key)[0] != part.column(key)[0]):
                yield together(held)
                held, waiting = [], 0
            held.append(part)
            waiting += part.column(text).nbytes
    if held:
        yield together(held)


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


@F.arrow_udf(T.LongType())
def term_count(texts: pa.Array) -> pa.Array:
    """The number of index terms of a lower-cased text; none for null."""
    lengths = [words.counts_of(texts.slice(at, stop - at)) for at, stop in words.pieces(texts)]
    return pa.array(np.concatenate(lengths) if lengths else np.zeros(0, np.int64), pa.int64())


def corpus_stats(chunks: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: number of chunks, those without any term included, and their mean length."""
    counted = chunks.agg(F.count("*").alias("n_docs"))
    return counted.withColumn("avg_dl", posted.agg(F.sum("tf").alias("n")).scalar() / F.col("n_docs"))


def term_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a term repeated in the query counts that often."""
    rows = queries.select("query_id", F.explode(index_terms(F.col("query"))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def inverse_frequency(df: Column, n_docs: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def term_score(tf: Column, dl: Column, avg_dl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def has_few_terms(queries: DataFrame) -> bool:
    """Whether the terms of all queries are few enough to broadcast. Looks at the queries only."""
    return query_terms(queries).limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS


def bm25(
    queries: DataFrame, posted: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75,
    allowed: Column | None = None, few_terms: bool | None = None, frequencies: DataFrame | None = None, scoped: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk sharing a term with the query.

    ``stats`` is one row. ``allowed`` restricts the results, the statistics stay those of the corpus. ``frequencies`` is a
    stored (term, df) table; without one the postings are counted. scoped: the postings have the array of `scopes` that accept
    them, the queries a scope_id.
    """
    few_terms = has_few_terms(queries) if few_terms is None else few_terms
    wanted = query_terms(queries)
    terms = wanted.select("term").distinct()
    if frequencies is None:
        frequencies = term_frequencies(posted.join(F.broadcast(terms), "term", "left_semi") if few_terms else posted)
    n_docs, avg_dl = (stats.select(c).scalar() for c in ("n_docs", "avg_dl"))
    weighted = wanted.join(frequencies, "term").select(
        "query_id", "term", (F.col("qtf") * inverse_frequency(F.col("df"), n_docs)).alias("weight")
    )
    if scoped:
        weighted = weighted.join(queries.select("query_id", "scope_id"), "query_id")
    pool = (posted if allowed is None else posted.filter(allowed)).select("chunk_id", "term", "tf", "dl", *(["scopes"] if scoped else []))
    if few_terms:
        # One exchange, of the postings of the query terms; the aggregation below needs none.
        dealt = pool.join(F.broadcast(terms), "term", "left_semi").repartition("chunk_id")
        matched = dealt.join(F.broadcast(weighted), "term")
    else:
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")
        spread = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = pool.withColumn("_salt", salt).join(spread, ["term", "_salt"])
    if scoped:
        matched = matched.filter(F.array_contains("scopes", F.col("scope_id")))
    score = F.col("weight") * term_score(F.col("tf"), F.col("dl"), avg_dl, k1, b)
    # Rounding makes chunks of equal text tie, in whatever order their terms were added up.
    return matched.groupBy("query_id", "chunk_id").agg(F.round(F.sum(score), 9).alias("score"))
