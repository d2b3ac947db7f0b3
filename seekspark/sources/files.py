"""Files of a tree that every executor can reach, mounted or by URI: listing, stat and text.

The listing goes level by level. Each level is one job over the directories of the level before, is
pruned by the ignore rules before anything below it is listed, and is written to the shared folder,
so a lost executor costs one level at most and the driver never holds the listing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.functions import paths
from seekspark.functions.globs import ignored, root_ignore_patterns
from seekspark.schemas import LISTING, struct
from seekspark.session import shared_folder
from seekspark.sources.stores import store_of

READ_SCHEMA = struct("path:string text:string error:string")
#: So many entries of a directory go on together.
PIECE = 1 << 14
#: So many bytes of files are read by one task.
READ_BYTES = 32 << 20


def ignore_patterns(cfg: EngineConfig) -> list[str]:
    """Safety patterns and the root ignore file. Nested ignore files are not read."""
    try:
        return root_ignore_patterns(store_of(cfg.watch_root).read(".gitignore").decode("utf-8", errors="replace"))
    except OSError:
        return root_ignore_patterns(None)


def accepted(cfg: EngineConfig, is_dir: bool = False, patterns: list[str] | None = None) -> Column:
    """Whether a path takes part in the index: exclusions win over includes, includes over ignore rules."""
    path = F.col("path")
    patterns = ignore_patterns(cfg) if patterns is None else patterns
    keep = ~paths.is_safety_ignored(path, check_parents=True) & ~ignored(path, cfg.index_exclude, is_dir)
    keep = keep & (~ignored(path, patterns, is_dir) | paths.is_covered_by(path, cfg.working_docs))
    if cfg.index_dir.startswith(cfg.watch_root + "/"):
        keep = keep & ~paths.is_under(path, cfg.index_dir[len(cfg.watch_root) + 1 :])
    return keep if is_dir else keep & paths.is_indexable(path)


def _entries(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = store_of(root)
        for batch in batches:
            for relative in batch["path"]:
                try:
                    rows = store.entries(relative)
                except OSError as failure:
                    rows = [(relative, 0, 0.0, True, str(failure))]
                for at in range(0, len(rows), PIECE):
                    yield pd.DataFrame(rows[at:at + PIECE], columns=LISTING.names)

    return run


def walk_files(spark: SparkSession, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(path, size, mtime_ms) of every file that takes part in the index, and (path, error) of what could not be listed.

    Nothing is known of a failed path and what lies below it. If the root itself cannot be listed, the walk fails.
    """
    folder = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    patterns, tasks = ignore_patterns(cfg), spark.sparkContext.defaultParallelism
    level, depth = spark.createDataFrame([("",)], "path string"), 0
    keep = F.col("error").isNotNull() | (F.col("is_dir") & accepted(cfg, True, patterns)) | (~F.col("is_dir") & accepted(cfg, False, patterns))
    while True:
        target = f"{folder}/depth={depth}"
        entries = level.mapInPandas(_entries(cfg.watch_root), LISTING).repartition(tasks, "path")
        # One directory may hold all files, and only one task lists it: what follows is dealt out. The generator keeps the filter above it.
        entries.withColumn("path", F.explode(F.array("path"))).filter(keep).select(*LISTING.names).write.parquet(target)
        listed = spark.read.schema(LISTING).parquet(target)
        if depth == 0 and (failed := listed.filter("path = '' AND error IS NOT NULL").first()):
            raise OSError(f"the root cannot be listed: {failed['error']}")
        directories = listed.filter("is_dir AND error IS NULL").select("path")
        if directories.isEmpty():
            break
        # Listing is latency bound: spread the directories over all tasks.
        level, depth = directories.repartition(tasks, "path"), depth + 1
    everything = spark.read.schema(LISTING).parquet(*[f"{folder}/depth={d}" for d in range(depth + 1)])
    return everything.filter("NOT is_dir AND error IS NULL").drop("is_dir", "error"), everything.filter("error IS NOT NULL").select("path", "error")


def not_below(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """The rows whose path is none of the failed ones and lies below none. Joins on the paths' ancestors."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    unknown = rows.select("path", F.explode(ancestors).alias("_above")).join(failed.select(F.col("path").alias("_above")), "_above", "left_semi")
    return rows.join(unknown.select("path").distinct(), "path", "left_anti")


def stat_files(named: DataFrame, cfg: EngineConfig) -> DataFrame:
    """path, size, mtime_ms of the given paths; a path that is no regular file has null size."""
    root = cfg.watch_root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = store_of(root)
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    state = store.stat(path)
                except OSError:
                    state = None
                rows.append((path, *(state or (None, None))))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime_ms"])

    return named.select("path").mapInPandas(run, struct("path:string size:bigint mtime_ms:double"))


def dealt_by_bytes(named: DataFrame, total: int) -> DataFrame:
    """Files to be read, (path, ...) of so many bytes together, dealt out to tasks: a listing lies in few pieces, as its rows are short."""
    return named.repartition(reading_tasks(named.sparkSession, total), "path")


def reading_tasks(spark: SparkSession, total: int) -> int:
    """Tasks to read files of so many bytes together. Small ones are latency bound."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))


def read_texts(named: DataFrame, cfg: EngineConfig, batch_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """Adds text and error to (path, ...). Invalid bytes become U+FFFD; a failed read does not stop the job."""
    root, columns = cfg.watch_root, named.columns
    schema = struct("path:string")
    for field in named.schema:
        if field.name != "path":
            schema = schema.add(field)
    schema = schema.add(READ_SCHEMA["text"]).add(READ_SCHEMA["error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = store_of(root)
        for batch in batches:
            rows, held = [], 0
            for record in batch[columns].itertuples(index=False):
                text = error = None
                try:
                    text = store.read(record.path).decode("utf-8", errors="replace")
                except OSError as failure:
                    error = str(failure)
                rows.append((*record, text, error))
                held += len(text or "")
                if held >= batch_bytes:
                    yield pd.DataFrame(rows, columns=[*columns, "text", "error"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=[*columns, "text", "error"])

    ordered = schema.names[:1] + [c for c in columns if c != "path"]
    return named.mapInPandas(run, schema.__class__([schema[n] for n in columns] + [schema["text"], schema["error"]])).select(*ordered, "text", "error")


def write_files(texts: DataFrame, root: str) -> int:
    """Writes (path, text) as files below a root that executors can reach; a file written twice by a repeated task is the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = store_of(root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                store.write(path, (text or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    return texts.select("path", "text").mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0
