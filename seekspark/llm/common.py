"""Helpers that several operators share: narrow inputs, small Arrow slices, bounded settings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: what else the input holds cannot clash."""
    return frame.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def whole_text(column: Column | str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def once(frame: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column that is computed once per row: nothing is copied through a generator, into the lambdas above it."""
    return frame.select("*", F.explode(F.array(column)).alias(name))


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most `rows` rows and about `chars` bytes of text, never inside a row."""
    for batch in batches:
        lengths = batch.column(text).nbytes / max(1, batch.num_rows)
        if lengths * batch.num_rows <= chars and batch.num_rows <= rows:
            if batch.num_rows:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


_ROWS_KEY, _SPARKS_OWN, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"


def small_batches(frame: DataFrame) -> DataFrame:
    """Has Spark send whole texts to Python in batches of 1,024 rows, unless the session says otherwise than by default.

    Ten thousand texts at once take tens of megabytes on either side; results do not depend on it.
    """
    if frame.sparkSession.conf.get(_ROWS_KEY) == _SPARKS_OWN:
        frame.sparkSession.conf.set(_ROWS_KEY, _ROWS)
    return frame


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema, strict=True)], schema=schema)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
