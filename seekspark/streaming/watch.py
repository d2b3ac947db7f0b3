"""Change events as a stream: every micro-batch is folded to one event per path and applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seekspark.config import EngineConfig
from seekspark.functions.globs import ignored
from seekspark.functions.paths import is_under, is_watch_skipped
from seekspark.plans.index import CodeIndex
from seekspark.schemas import CHANGES
from seekspark.streaming.settle import held_back


def change_events(spark: SparkSession, folder: str, cfg: EngineConfig, max_files: int = 1_000) -> DataFrame:
    """JSON files of (seq, path, event) as a stream, without the paths a watcher leaves alone."""
    events = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).json(folder)
    return watched(events, cfg)


def watched(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    path = F.col("path")
    excluded = ignored(path, cfg.index_exclude, True) | ignored(path, cfg.index_exclude, False)
    keep = ~is_watch_skipped(path, cfg.working_docs, excluded)
    if cfg.index_dir.startswith(cfg.watch_root + "/"):
        keep = keep & ~is_under(path, cfg.index_dir[len(cfg.watch_root) + 1 :])
    return events.filter(keep)


def diff_events(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """What polling finds: (path, event) between a listing and the manifest."""
    both = listed.select("path", "size", "mtime_ms").join(
        manifest.select("path", F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime")), "path", "full_outer"
    )
    event = (
        F.when(F.col("size").isNull(), "unlink").when(F.col("_size").isNull(), "add")
        .when((F.col("size") != F.col("_size")) | (F.col("mtime_ms") != F.col("_mtime")), "change")
    )
    return both.select("path", event.alias("event")).filter("event IS NOT NULL")


def start_watching(
    index: CodeIndex, events: DataFrame, checkpoint: str, available_now: bool = False,
    after_batch: Callable[[dict], None] | None = None, settle_ms: int = 0,
) -> StreamingQuery:
    """Applies the stream of (seq, path, event) to the index, each batch once.

    The version that a batch makes names it; a batch that comes again after a restart finds its number there. Batches are
    numbered by the checkpoint, which therefore names the stream. With settle_ms, a path is applied when it has been quiet
    that long.
    """
    return _each_batch_once(held_back(events, settle_ms) if settle_ms else events, checkpoint, index.apply_changes, index, available_now, after_batch)


def start_replay(index: CodeIndex, events: DataFrame, checkpoint: str, after_batch: Callable[[dict], None] | None = None) -> StreamingQuery:
    """The same for events that bring their texts, (seq, path, event, text), until what is there now is read."""
    return _each_batch_once(events, checkpoint, index.apply_texts, index, True, after_batch)


def _each_batch_once(events: DataFrame, checkpoint: str, apply: Callable, index: CodeIndex, available_now: bool, after_batch) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        result = apply(batch, (checkpoint, number))
        if after_batch:
            after_batch(result)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{index.cfg.poll_interval_ms} milliseconds").start()
