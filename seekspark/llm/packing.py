"""Packing along a space-filling curve.

Documents are tokenised once; a hashed token histogram is projected to a few dimensions and gets a Hilbert key. The table
of ids is range-partitioned and sorted by that key, and each task lays its documents end to end along the curve, cutting
at every `length` tokens, so neighbours on the curve share sequences. What is left at the end of a task is cut into powers
of two, which need no padding. A task holds one batch and one open sequence.

Defined cases: null text is empty and packs its end token alone. Rows that repeat an id are packed each, told apart by
`copy`; hot keys (many copies) are split among tasks by id. Null ids, empty tables and extra columns do no harm. A text of
any length is packed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import batch_of, slices, small_batches, whole_text
from seekspark.llm.hilbert import hilbert_keys, projection, to_cells
from seekspark.llm.tokens import tokenizer_text, word_tokenizer
from seekspark.session import written


@dataclass(frozen=True)
class PackingConfig:
    """end: the id behind every document; task_tokens: about how many tokens one task packs."""

    length: int = 4096
    end: int = 2
    dims: int = 4
    bits: int = 15
    hashed: int = 256
    seed: int = 11
    task_tokens: int = 4_000_000


def curve_keys(ids: list[np.ndarray], config: PackingConfig) -> np.ndarray:
    """Hilbert keys of the documents' hashed, damped and normalised token histograms."""
    lengths = np.array([len(x) for x in ids])
    owner = np.repeat(np.arange(len(ids)), lengths)
    hashed = (np.concatenate(ids).astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(7)) % np.uint32(config.hashed)
    counts = np.bincount(owner * config.hashed + hashed, minlength=len(ids) * config.hashed).reshape(len(ids), -1)
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    points = vectors @ projection(config.seed, config.hashed, config.dims)
    return hilbert_keys(to_cells(points, 1 / np.sqrt(config.hashed) * 2, config.bits), config.bits)


def tokenised(docs: DataFrame, config: PackingConfig = PackingConfig(), tokenizer: str | None = None) -> DataFrame:
    """doc_id, curve (key), n (tokens), ids (binary, end token included)."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))
    rows = docs.select("doc_id", whole_text("text").alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("curve"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("ids")).schema

    def run(batches):
        maker = word_tokenizer(definition.value)
        end = np.array([config.end], maker.type).tobytes()
        for part in slices(batches, "text"):
            raw = [x + end for x in maker.ids(part.column("text").to_pylist())]
            ids = [np.frombuffer(x, maker.type) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(curve_keys(ids, config)), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())],
                names=["doc_id", "curve", "n", "ids"])

    return small_batches(rows).mapInArrow(run, schema)


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


_PIECES = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("copy", pa.int32())]


class _Packer:
    """Lays documents end to end; full sequences leave at once, the open one is held as (row number, start, ids)."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.next, self.open, self.held, self.rows = length, first, [], 0, []

    def add(self, document: tuple, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            piece = ids[at:at + self.length - self.held]
            self.open.append((document, at, piece))
            self.held += len(piece)
            at += len(piece)
            if self.held == self.length:
                self._emit(self.open)
                self.open, self.held = [], 0

    def _emit(self, pieces: list) -> None:
        offset = 0
        for (key, copy, tokens), start, ids in pieces:
            self.rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.next, offset, copy))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        rest = self.open[::-1]
        for size in powers_of_two(self.held):
            sequence = []
            while size:
                document, start, ids = rest.pop()
                if len(ids) > size:
                    rest.append((document, start + size, ids[size:]))
                    ids = ids[:size]
                sequence.append((document, start, ids))
                size -= len(ids)
            self._emit(sequence)
        self.open, self.held = [], 0


def _pack(config: PackingConfig, kind: str):
    def run(batches: Iterator[pa.RecordBatch]):
        packer = _Packer(config.length, TaskContext.get().partitionId() << 36)
        previous, copy, key_type = object(), 0, None

        def out():
            columns = list(zip(*packer.rows, strict=True)) if packer.rows else [[]] * 8
            packer.rows = []
            schema = pa.schema([("doc_id", key_type), *_PIECES])
            return batch_of(schema, list(columns))

        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            keys = batch.column("doc_id").to_pylist()
            ids = batch.column("ids")
            for row, key in enumerate(keys):
                copy = copy + 1 if key == previous else 0
                previous = key
                made = np.frombuffer(ids[row].as_buffer(), np.dtype(kind))
                packer.add((key, copy, len(made)), made)
                if len(packer.rows) >= 4096:
                    yield out()
        if key_type is not None:
            packer.finish()
            yield out()

    return run


def pack(docs: DataFrame, config: PackingConfig = PackingConfig(), tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, copy."""
    kind = word_tokenizer(tokenizer_text(tokenizer)).type.str
    table = written(tokenised(docs, config, tokenizer), "packing-ids")
    total = table.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total // config.task_tokens))
    schema = table.select(
        "doc_id", *[F.lit(0).cast("long").alias(n) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        F.lit(0).cast("int").alias("copy")).schema
    along = table.select("curve", "doc_id", "ids").repartitionByRange(tasks, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    return along.select("doc_id", "ids").mapInArrow(_pack(config, kind), schema)


def sequences(docs: DataFrame, config: PackingConfig = PackingConfig(), tokenizer: str | None = None) -> DataFrame:
    """sequence_id and its token ids in order: the pieces joined with their documents' ids. Ids must be unique here."""
    kind = word_tokenizer(tokenizer_text(tokenizer)).type.str
    table = written(tokenised(docs, config, tokenizer), "packing-ids").select("doc_id", "ids")
    width = np.dtype(kind).itemsize
    piece = F.substring(F.col("ids"), F.col("start").cast("int") * width + 1, F.col("length").cast("int") * width)
    cut = pack(docs, config, tokenizer).join(table, "doc_id").select("sequence_id", F.struct("offset", piece.alias("ids")).alias("p"))
    return cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
