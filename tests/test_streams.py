"""Settling by the clock, and batches that come again."""

import time

from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.plans.index import CodeIndex
from seekspark.schemas import CHANGES
from seekspark.streaming.settle import held_back
from seekspark.streaming.watch import start_replay


def test_a_path_is_passed_on_once_it_is_quiet(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def put(*rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").json(feed)

    put((1, "a", "add"), (2, "a", "change"), (3, "b", "add"))
    stream = spark.readStream.schema(CHANGES).json(feed)
    query = held_back(stream, 3_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option(
        "path", out).trigger(processingTime="200 milliseconds").start()
    try:
        put((4, "b", "unlink"), (5, "c", "add"), (4, "c", "change"))
        for _ in range(120):
            time.sleep(0.5)
            rows = [] if query.lastProgress is None else sorted(tuple(r) for r in spark.read.schema(CHANGES).parquet(out).collect())
            if len(rows) >= 3:
                break
    finally:
        query.stop()
    assert rows == [(2, "a", "change"), (4, "b", "unlink"), (5, "c", "add")]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    index = CodeIndex(spark, EngineConfig(watch_root=str(tmp_path), index_dir=str(tmp_path / "index"), embedding_dim=8, path_buckets=1)).open()
    ddl = "seq bigint, path string, event string, text string"
    first = spark.createDataFrame([(1, "a.py", "add", "one"), (2, "b.py", "add", "two"), (3, "a.py", "change", "three"), (4, "x.py", "open", "no")], ddl)
    first.write.parquet(str(tmp_path / "feed"))
    results = []
    start_replay(index, spark.readStream.schema(first.schema).parquet(str(tmp_path / "feed")), str(tmp_path / "state"), results.append).awaitTermination()
    assert [r["indexed"] for r in results] == [2]
    version, stream = index.version(), str(tmp_path / "state")
    assert index.is_applied((stream, 0)) and not index.is_applied((stream, 1)) and not index.is_applied(("other", 0))
    gone = spark.createDataFrame([(9, "a.py", "unlink", None)], ddl)
    assert index.apply_texts(gone, (stream, 0)) == {} and index.version() == version
    assert index.apply_texts(gone, (stream, 1))["removed"] == 1
    assert [(r.path, r.body) for r in index.table("chunks").select("path", "body").collect()] == [("b.py", "two")]
    # A batch without effect is noted as well.
    assert index.apply_texts(gone.filter(F.lit(False)), (stream, 2))["indexed"] == 0 and index.is_applied((stream, 2))
