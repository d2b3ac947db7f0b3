"""Change detection: which files to read, which changed, which are gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def with_known_state(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Current files (path, size, mtime_ms) beside what the manifest remembers of them."""
    known = manifest.select(
        "path", F.col("sha256").alias("known_sha256"), F.col("size").alias("known_size"),
        F.col("mtime_ms").alias("known_mtime_ms"),
    )
    return files.join(known, "path", "left")


def stat_unchanged() -> Column:
    """Known content hash, same size and same modification time: no need to read the file."""
    same = (
        F.col("known_sha256").isNotNull() & (F.col("size") == F.col("known_size"))
        & (F.col("mtime_ms") == F.col("known_mtime_ms"))
    )
    return F.coalesce(same, F.lit(False))


def hash_unchanged() -> Column:
    return F.coalesce(F.col("sha256") == F.col("known_sha256"), F.lit(False))


def removed_paths(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Known paths that are not on disk any more."""
    return manifest.select("path").join(files.select("path"), "path", "left_anti")


def upsert(chunks: DataFrame, fresh: DataFrame, touched: DataFrame, few: bool = False) -> DataFrame:
    """Rows of untouched paths, and the fresh rows of the touched ones."""
    return untouched(chunks, touched, few).unionByName(fresh, allowMissingColumns=True)


def untouched(chunks: DataFrame, touched: DataFrame, few: bool = False, hashed: bool = False) -> DataFrame:
    """Rows of untouched paths. ``few``: the touched paths may be broadcast; ``hashed``: their hashes may, as no other path shares
    one; otherwise they are hashed, so that the chunks are dealt out but not sorted for them."""
    if hashed:
        return _by_hash(chunks, touched, ["path"], "left_anti")
    paths = touched.select("path").distinct()
    return chunks.join(F.broadcast(paths) if few else paths.hint("shuffle_hash"), "path", "left_anti")


def rows_of(rows: DataFrame, wanted: DataFrame, few: bool = False, hashed: bool = False) -> DataFrame:
    """The rows whose (path, sha256) is wanted; few and hashed as above."""
    if hashed:
        return _by_hash(rows, wanted, ["path", "sha256"], "left_semi")
    return rows.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["path", "sha256"], "left_semi")


def hash_of(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _by_hash(rows: DataFrame, keys: DataFrame, columns: list[str], how: str) -> DataFrame:
    hashes = F.broadcast(keys.select(hash_of(*columns).alias("_hash")).distinct())
    return rows.withColumn("_hash", hash_of(*columns)).join(hashes, "_hash", how).drop("_hash")


def share_a_hash(rows: DataFrame, keys: DataFrame, *columns: str) -> bool:
    """Whether rows that have none of the keys share a hash with one of them. Looks at these columns only, by default (path, sha256)."""
    names = list(columns or ("path", "sha256"))
    others = rows.select(*names).distinct().join(keys.select(*names).hint("shuffle_hash"), names, "left_anti")
    return not _by_hash(others, keys, names, "left_semi").isEmpty()


def last_event_per_path(events: DataFrame) -> DataFrame:
    """(seq, path, event) -> the latest add, change or unlink of each path. Other events do not count."""
    known = events.filter(F.col("event").isin("add", "change", "unlink"))
    return known.groupBy("path").agg(F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"))
