"""Spans of findings as an array column: kind, start, end (code points, end exclusive), base."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import slices, small_batches, whole_text

SPANS_DDL = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

#: What a finder gives for a text: (kind, start, end, whether it is a base span).
Found = list[tuple[str, int, int, bool]]


def with_spans(docs: DataFrame, finder: Callable[[str], Found], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and `spans`, in the finder's order. Null text counts as empty. The finder runs in Arrow slices."""
    read = text if text in keep else "_text"
    rows = docs.select(*[f"`{c}`" for c in keep], *([] if text in keep else [whole_text(F.col(f"`{text}`")).alias("_text")]))
    schema = docs.select(*[f"`{c}`" for c in keep], F.lit(None).cast(SPANS_DDL).alias("spans")).schema

    def run(batches):
        for part in slices(batches, read):
            found = [
                [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in finder(text or "")]
                for text in part.column(read).to_pylist()
            ]
            kept = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, _SPANS)], names=[*keep, "spans"])

    return small_batches(rows).mapInArrow(run, schema)


def base_spans() -> Column:
    return F.filter("spans", lambda s: s["base"])


def count_of(kind: str) -> Column:
    """How many base spans of the kind."""
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """doc_id, one count per kind, the digest of the base spans and all spans as text."""
    return docs.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in kinds], F.sha2(joined(base_spans()), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
