"""The index: versioned Parquet tables partitioned by a hash of the path, and the calls that keep and search them.

A change writes the buckets its paths fall into, whole, into folders of a new version, and never touches older ones. When
all tables are written, one row is appended to the log of versions; from then on it is the current one. The row says which
buckets of which table the version holds, so a version is put together from the last folder of every bucket. A job that
dies before that row leaves nothing that anybody reads, and is simply repeated. `at` gives a reader of one version: what it
reads stays the same, however the index moves on. There is one writer at a time; old versions are not deleted.
Choose ``path_buckets`` so that a bucket holds a few hundred megabytes.
"""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark import schemas
from seekspark.config import ConfigError, EngineConfig
from seekspark.functions.globs import root_ignore_patterns
from seekspark.operators import blockmax, changes, fulltext
from seekspark.operators.chunking import chunk_files, chunk_id, embedding_text, storage_header
from seekspark.operators.embedding import embed_column
from seekspark.operators.rerank import PairScorer
from seekspark.plans.search import (
    SearchRequest, SearchTables, bucket_of, error_json, hit_payload, queries_frame, result_json, search_plan, search_requests,
    with_vectors,
)
from seekspark.sources.files import accepted, not_below, read_texts, reading_tasks, stat_files, walk_files
from seekspark.session import shared_folder, written

log = logging.getLogger(__name__)
#: So many changed paths are broadcast to the rows of their buckets.
MAX_TOUCHED = 100_000
#: So many as 64-bit hashes, once it is known that no other path shares one.
MAX_HASHED = 4_000_000
#: Texts of so many bytes are divided by one task, and the least that are worth another one.
PIECE_BYTES, LEAST_PIECE = 64 << 20, 2 << 20
#: So many buckets may be written at once by a task whose rows are not sorted by bucket; for others it sorts them.
OPEN_BUCKETS = 8
BUCKET_STATS = schemas.struct("path_bucket:int n_chunks:bigint n_terms:bigint path:string")
VERSIONS = schemas.struct("version:bigint tables:string wiped:boolean embedding_model:string embedding_dim:int watch_root:string last_full_scan_at:timestamp stream:string batch:bigint")
TERM_DF = schemas.struct("term:string level:int df:bigint max_tf:bigint min_dl:bigint path:string path_bucket:int")
STAGED = {"chunks": schemas.CHUNKS, "term_df": TERM_DF, "postings": schemas.POSTINGS, "file_manifest": schemas.MANIFEST, "bucket_stats": BUCKET_STATS}
#: Made from tables that lie by bucket: a task has few buckets, and its rows are written where they are made, in the order in which
#: they are made, which is that of the table.
DEALT = ("postings", "term_df")
#: The keys of postings repeat all over a row group: it must not outgrow their dictionaries.
FORMAT = {"postings": {"parquet.block.size": 32 << 20, "parquet.dictionary.page.size": 8 << 20}, "staging": {"parquet.block.size": 32 << 20, "compression": "zstd"}}


#: What stands in for a column that older folders lack.
DEFAULTS: dict[str, dict[str, Callable[[], Column]]] = {"chunks": {"definition_of": lambda: F.lit(""), "dl": lambda: missing_length()}}


def searchable() -> Column:
    """The text of a chunk that its postings are made of."""
    return F.concat_ws(" ", "header", "body")


def chunk_length() -> Column:
    return fulltext.term_count(F.lower(searchable()))


def missing_length() -> Column:
    """The length of a chunk that lacks it; texts of others are not looked at."""
    return fulltext.term_count(F.when(F.col("dl").isNull(), F.lower(searchable())))


class CodeIndex:
    """Open it with a session and a configuration; every call returns DataFrames or plain values."""

    def __init__(self, spark: SparkSession, cfg: EngineConfig, make_scorer: Callable[[], PairScorer] | None = None):
        self.spark, self.cfg, self.make_scorer = spark, cfg, make_scorer
        self.pinned: int | None = None
        self._held: list[Row] | None = None

    # ---- versions ----------------------------------------------------------------------------------
    def _where(self, name: str) -> str:
        return os.path.join(self.cfg.index_dir, name)

    def read_log(self) -> list[Row]:
        """The versions up to the pinned one, oldest first: one row for each change of the index. A reader of one version reads
        them once."""
        if self._held is not None:
            return self._held
        try:
            rows = self.spark.read.schema(VERSIONS).json(self._where("versions")).collect()
        except AnalysisException:
            return []
        found = sorted((r for r in rows if self.pinned is None or r["version"] <= self.pinned), key=lambda r: r["version"])
        if self.pinned is not None:
            self._held = found
        return found

    def version(self) -> int:
        """The number of the current (or pinned) version, 0 before the first."""
        log_rows = self.read_log()
        return log_rows[-1]["version"] if log_rows else 0

    def at(self, version: int | None = None) -> CodeIndex:
        """A reader of that version, by default of the one that is current now."""
        rows = [r for r in self.read_log() if version is None or r["version"] <= version]
        reader = CodeIndex(self.spark, self.cfg, self.make_scorer)
        reader.pinned, reader._held = rows[-1]["version"] if rows else 0, rows
        return reader

    def is_applied(self, batch: tuple[str, int] | None) -> bool:
        """Whether a version holds that batch of that stream, or a later one. The log of versions is the ledger."""
        return batch is not None and any(r["stream"] == batch[0] and r["batch"] >= batch[1] for r in self.read_log())

    def _commit(
        self, version: int, tables: dict[str, Sequence[int]], wiped: bool = False, scanned: bool = False, batch: tuple[str, int] | None = None,
    ) -> None:
        """Appends the row of a version. It is one file, so it is there as a whole or not at all, and so is the batch with it."""
        previous = self.read_meta() or {}
        row = (version, json.dumps({k: list(v) for k, v in tables.items()}), wiped, self.cfg.embedding_model, self.cfg.embedding_dim,
               self.cfg.watch_root, None if wiped else previous.get("last_full_scan_at"), *(batch or (None, None)))
        frame = self.spark.createDataFrame([row], VERSIONS)
        if scanned:
            frame = frame.withColumn("last_full_scan_at", F.current_timestamp())
        frame.coalesce(1).write.mode("append").json(self._where("versions"))

    def _folders(self, name: str) -> dict[int, list[int]]:
        """For each version the buckets of a table that it is the last to hold."""
        last: dict[int, int] = {}
        for row in self.read_log():
            if row["wiped"]:
                last.clear()
            last.update(dict.fromkeys(json.loads(row["tables"]).get(name, []), row["version"]))
        folders: dict[int, list[int]] = {}
        for bucket, version in last.items():
            folders.setdefault(version, []).append(bucket)
        return folders

    # ---- tables ----------------------------------------------------------------------------------
    def table(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """A table of the index, empty if it was never written. ``buckets`` prunes the scan.

        A column that a folder lacks, as an older engine wrote it, is filled as DEFAULTS says; it is written along when its
        bucket is written next.
        """
        schema, folders = STAGED[name], self._folders(name)
        if buckets is not None:
            wanted = set(buckets)
            folders = {v: [b for b in held if b in wanted] for v, held in folders.items()}
        parts = [(F.col("version") == v) & F.col("path_bucket").isin(held) for v, held in sorted(folders.items()) if held]
        if not parts:
            return self.spark.createDataFrame([], schema)
        try:
            frame = self.spark.read.schema(schemas.versioned(schema)).parquet(self._where(name))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        frame = frame.filter(reduce(lambda a, b: a | b, parts))
        filled = {c: F.coalesce(c, default()).alias(c) for c, default in DEFAULTS.get(name, {}).items()}
        return frame.select(*[filled.get(c, F.col(c)) for c in schema.names])

    def is_indexed(self) -> bool:
        return bool(self._folders("chunks"))

    def _write(self, frame: DataFrame, name: str, version: int, *order: str) -> None:
        """A table's buckets of a version that is not committed yet; what a dead attempt left there goes. Chunks come by bucket
        already, a few in every task; so does what is DEALT, which is sorted, too."""
        target = f"{self._where(name)}/version={version}"
        rows = frame.select(*STAGED[name].names)
        if name not in DEALT:
            rows = rows if name == "chunks" else rows.hint("rebalance", "path_bucket")
            rows = rows.sortWithinPartitions("path_bucket", *order)
        with self._unsorted(name in DEALT):
            rows.write.mode("overwrite").options(**FORMAT.get(name, {})).option(
                "partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("path_bucket").parquet(target)

    @contextmanager
    def _unsorted(self, wanted: bool = True) -> Iterator[None]:
        """While it holds, a task keeps some buckets open instead of sorting its rows by bucket."""
        name = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(name, None)
        if wanted:
            self.spark.conf.set(name, str(OPEN_BUCKETS))
        try:
            yield
        finally:
            if wanted:
                self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)

    def _written(self, name: str, version: int) -> DataFrame:
        """What was just written of a version, before it is committed."""
        schema = STAGED[name]
        return self.spark.read.schema(schema).parquet(f"{self._where(name)}/version={version}").select(*schema.names)

    # ---- meta --------------------------------------------------------------------------------------
    def read_meta(self) -> dict | None:
        """Model, dimension, root and time of the last scan; None before the first version."""
        rows = self.read_log()
        return {f: rows[-1][f] for f in schemas.META.names} if rows else None

    def open(self) -> CodeIndex:
        """Prepares the index for writing: a changed model, dimension or root empties it."""
        meta = self.read_meta()
        same = meta and (
            (meta["embedding_model"], meta["embedding_dim"], meta["watch_root"])
            == (self.cfg.embedding_model, self.cfg.embedding_dim, self.cfg.watch_root)
        )
        if meta and not same:
            log.warning("model, dimension or root changed; the index starts anew")
        if not same:
            self.wipe()
        return self

    def wipe(self) -> None:
        """A version without any rows; readers of older ones keep theirs."""
        self._commit(self.version() + 1, {}, wiped=True)

    # ---- writing -----------------------------------------------------------------------------------
    def _bucket(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("path_bucket", bucket_of(F.col("path"), self.cfg.path_buckets))

    def _dealt(self, rows: DataFrame, buckets: Sequence[int], tasks: int) -> DataFrame:
        """Rows with a path_bucket dealt out to about so many tasks. A bucket goes to several, if there are fewer buckets, and a
        task has one then."""
        if len(buckets) >= tasks:
            return rows.repartition(tasks, "path_bucket")
        each = -(-tasks // len(buckets))
        number = F.array_position(F.lit(list(buckets)), F.col("path_bucket")).cast("int") - 1
        return rows.repartitionById(each * len(buckets), number * each + F.pmod(F.hash("path"), F.lit(each)))

    def _chunk_rows(self, texts: DataFrame) -> DataFrame:
        """(path, path_bucket, text) -> rows of the chunk table."""
        cut = chunk_files(texts.select("path", "path_bucket", "text"), self.cfg)
        rows = cut.withColumns({
            "chunk_id": chunk_id(F.col("path"), F.col("ordinal")),
            "header": storage_header(F.col("path")),
            "vector": embed_column(embedding_text(self.cfg.embed_definition_tag), self.cfg),
            "definition_of": F.coalesce("definition_of", F.lit("")),
        }).withColumn("dl", chunk_length())
        return rows.select(*schemas.CHUNKS.names)

    def _index(self, listed: DataFrame, removed: DataFrame, source: Callable[[], DataFrame] | None = None, scanned: bool = False,
               batch: tuple[str, int] | None = None, repeated: bool = False) -> dict[str, int]:
        """Brings the tables up to the listed files (path, size, mtime_ms) and drops the removed paths, as one version.

        source: gives (path, text) of texts at hand; the listing then has their sha256, only it is staged, and max_file_bytes
        does not hold; ``repeated``: it has other texts of these paths, too. By default the files are opened below the root, and
        what was read is staged.
        """
        if self.pinned is not None:
            raise ConfigError("a reader of one version does not write")
        staging = f"{shared_folder(self.spark)}/staging-{uuid.uuid4().hex}"
        now = self.at()
        version = now.pinned + 1
        known = changes.with_known_state(listed, now.table("file_manifest"))
        too_large = F.lit(False) if source else F.col("size") > self.cfg.max_file_bytes
        left = known.agg(
            F.count_if(changes.stat_unchanged() & ~too_large).alias("stat_skipped"), F.count_if(too_large).alias("too_large"),
            F.coalesce(F.sum(F.when(~changes.stat_unchanged() & ~too_large, F.col("size"))), F.lit(0)).alias("bytes"),
        ).first().asDict()
        pending_bytes = left.pop("bytes")
        pending = known.filter(~changes.stat_unchanged() & ~too_large)
        if source:
            read_once = pending.withColumn("error", F.lit(None).cast("string"))
        else:
            # Staged with their texts: reading files again for every table could see other contents.
            # They are opened by bucket, so that their chunks are made and written where the texts lie.
            dealt = self._dealt(self._bucket(pending), range(self.cfg.path_buckets), reading_tasks(self.spark, pending_bytes))
            read_once = read_texts(dealt, self.cfg).withColumn("sha256", changes.content_hash(F.col("text")))
        read_once = self._bucket(read_once)
        with self._unsorted(not source):
            rows = read_once.write.options(**FORMAT["staging"])
            (rows if source else rows.partitionBy("path_bucket")).parquet(f"{staging}/files")
        staged = self.spark.read.schema(read_once.schema).parquet(f"{staging}/files")
        good = staged.filter("error IS NULL")
        changed = good.filter(~changes.hash_unchanged())
        if self.cfg.strict_size and not source:
            removed = removed.unionByName(listed.filter(F.col("size") > self.cfg.max_file_bytes).select("path"))
        self._bucket(removed.select("path").distinct()).write.parquet(f"{staging}/removed")
        gone = self.spark.read.parquet(f"{staging}/removed")
        touched = changed.select("path", "path_bucket").unionByName(gone.select("path", "path_bucket"))
        buckets = sorted(r.path_bucket for r in touched.select("path_bucket").distinct().collect())
        counts = staged.agg(
            F.count_if(F.expr("error IS NULL") & ~changes.hash_unchanged()).alias("indexed"),
            F.count_if(F.expr("error IS NULL") & changes.hash_unchanged()).alias("hash_skipped"),
            F.count_if(F.expr("error IS NOT NULL")).alias("failed"),
            F.coalesce(F.sum(F.when(F.expr("error IS NULL") & ~changes.hash_unchanged(), F.col("size"))), F.lit(0)).alias("bytes"),
        ).first().asDict()
        changed_bytes = counts.pop("bytes")
        tables: dict[str, list[int]] = {}
        if buckets:
            texts = changed
            if source and counts["indexed"]:
                wanted, every = changed.select("path", "sha256"), not counts["hash_skipped"] and not left["stat_skipped"]
                hashed = not repeated and MAX_TOUCHED < counts["indexed"] <= MAX_HASHED and (every or not changes.share_a_hash(listed, wanted))
                found = changes.rows_of(source(), wanted, counts["indexed"] <= MAX_TOUCHED, hashed).select("path", "text")
                tasks = min(2 * self.spark.sparkContext.defaultParallelism, changed_bytes // LEAST_PIECE)
                texts = self._dealt(self._bucket(found), buckets, max(1, tasks, -(-changed_bytes // PIECE_BYTES)))
            now._rewrite(self._chunk_rows(texts) if counts["indexed"] else None, touched, buckets, version)
            tables = dict.fromkeys(("chunks", "postings", "term_df", "bucket_stats"), buckets)
        known_files = good.select(*schemas.MANIFEST.names)
        dropped = known_files.select("path", "path_bucket").unionByName(gone.select("path", "path_bucket"))
        entries = sorted(r.path_bucket for r in dropped.select("path_bucket").distinct().collect())
        if entries:
            self._write(changes.upsert(now.table("file_manifest", entries), known_files, dropped), "file_manifest", version, "path")
            tables["file_manifest"] = entries
        if tables or scanned or batch:
            self._commit(version, tables, scanned=scanned or counts["indexed"] > 0, batch=batch)
        if counts["failed"]:
            log.warning("%s files could not be read; they are tried again next time", counts["failed"])
        if left["too_large"]:
            kept = "are taken out of the index" if self.cfg.strict_size else "keep what the index held of them"
            log.warning("%s files are larger than max_file_bytes and %s", left["too_large"], kept)
        return {**counts, **left, "removed": gone.count()}

    def _rewrite(self, fresh: DataFrame | None, touched: DataFrame, buckets: list[int], version: int) -> None:
        """Chunks, then all that follows from them, into the folders of a version. Fresh chunks lie by bucket already; they are
        written once and read back.

        The chunks of untouched paths are carried over where they lie. Postings are made anew from the chunks of the buckets: they
        are sorted and written where they are made, without an exchange, a file for each piece of a chunk file. So are
        the counts of the terms, from the texts again, as that costs less than reading every posting; readers add them up.
        """
        held = self.table("chunks", buckets)
        if any(set(b) & set(buckets) for b in self._folders("chunks").values()):
            n = touched.count()
            hashed = MAX_TOUCHED < n <= MAX_HASHED and not changes.share_a_hash(held, touched, "path")
            kept = changes.untouched(held, touched, n <= MAX_TOUCHED, hashed)
            # Rows that were dealt out for the join by path do not lie by bucket.
            kept = kept if n <= MAX_TOUCHED or hashed else kept.hint("rebalance", "path_bucket")
            rows = kept if fresh is None else kept.unionByName(fresh)
        else:
            rows = held if fresh is None else fresh
        self._write(rows, "chunks", version, "path", "chunk_id")
        chunks = self._written("chunks", version)
        posted = fulltext.postings(chunks, searchable(), ("chunk_id", "path", "path_bucket"), runs_of="path_bucket")
        self._write(posted, "postings", version, "term")
        counted = blockmax.text_counts(chunks, searchable(), "path_bucket")
        self._write(counted.withColumn("path", F.lit("*")), "term_df", version, "term")
        # The lengths come from the chunk table, which also counts chunks without any term.
        sums = chunks.groupBy("path_bucket").agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("n_terms"))
        self._write(sums.withColumn("path", F.lit("*")), "bucket_stats", version)

    # ---- tables as input ---------------------------------------------------------------------------
    def index_table(self, texts: DataFrame, remove_missing: bool = False, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Indexes (path, text [, mtime_ms]) rows of any source instead of files below the root.

        Paths are repo-relative. Of several rows of one path the latest counts (greatest mtime_ms, then greatest hash). The
        path rules of a file scan hold, without an ignore file. Without mtime_ms a text counts as changed unless its hash is
        known. Texts may have any length. With ``remove_missing``, indexed paths that the table lacks go; so do the
        paths of ``removed``. A ``batch``, (stream, number), that a version holds already changes nothing.
        """
        if self.is_applied(batch):
            return {}
        mtime = F.col("mtime_ms").cast("double") if "mtime_ms" in texts.columns else F.lit(None).cast("double")
        # The generator holds the text: filters on its hash would make it anew, below every exchange.
        held = F.explode(F.array(F.coalesce("text", F.lit("")))).alias("text")
        rows = texts.select("path", held, mtime.alias("mtime_ms")).filter(
            accepted(self.cfg, patterns=root_ignore_patterns(None))).withColumn("sha256", changes.content_hash(F.col("text")))
        # Texts do not take part in the listing; those that changed are read again from their source.
        state = F.struct(F.coalesce("mtime_ms", F.lit(float("-inf"))).alias("at"), "sha256", F.octet_length("text").cast("bigint").alias("size"), "mtime_ms")
        latest = rows.groupBy("path").agg(F.max(state).alias("_s"), F.count("*").alias("_n"))
        listed = written(latest.select("path", "_s.size", "_s.mtime_ms", "_s.sha256", "_n"), "listing")
        repeated = not listed.filter("_n > 1").isEmpty()
        gone = self.spark.createDataFrame([], "path string") if removed is None else removed.select("path")
        if remove_missing:
            gone = gone.unionByName(changes.removed_paths(self.table("file_manifest"), listed))

        def source() -> DataFrame:
            found = rows.select("path", "text", "sha256")
            return found.dropDuplicates(["path", "sha256"]) if repeated else found

        return self._index(listed.drop("_n"), gone, source, scanned=True, batch=batch, repeated=repeated)

    def apply_texts(self, events: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """(seq, path, event, text): the last event of each path decides; its text is indexed, or the path goes."""
        if self.is_applied(batch):
            return {}
        known = events.filter(F.col("event").isin("add", "change", "unlink"))
        last = written(known.groupBy("path").agg(F.max_by(F.struct("event", "text"), "seq").alias("_l")).select("path", "_l.*"), "events")
        return self.index_table(last.filter("event <> 'unlink'").select("path", "text"), removed=last.filter("event = 'unlink'"), batch=batch)

    def remove_table(self, named: DataFrame) -> dict[str, int]:
        """Drops the paths of (path) from the index."""
        nothing = self.spark.createDataFrame([], "path string, size bigint, mtime_ms double")
        return self._index(nothing, named.select("path"))

    # ---- scans, reconcile, events ------------------------------------------------------------------
    def full_scan(self) -> dict[str, int]:
        """Indexes new and changed files; nothing is removed."""
        nothing = self.spark.createDataFrame([], "path string")
        listed, failed = walk_files(self.spark, self.cfg)
        return {**self._index(listed, nothing, scanned=True), "unlisted": self._unlisted(failed)}

    def _unlisted(self, failed: DataFrame) -> int:
        count = failed.count()
        if count:
            log.warning("%s paths could not be listed; what is indexed below them stays", count)
        return count

    def reconcile(self) -> dict[str, int]:
        """A full scan that also drops known paths no longer on disk. What lies below a directory that could not be listed
        is unknown, not gone."""
        listed, failed = walk_files(self.spark, self.cfg)
        gone = not_below(changes.removed_paths(self.table("file_manifest"), listed), failed)
        return {**self._index(listed, gone, scanned=True), "unlisted": self._unlisted(failed)}

    def reindex(self, path: str | None = None) -> dict:
        """One file, absolute or relative to the root, or everything."""
        if not path:
            return {"ok": True, "mode": "reconcile", **self.reconcile()}
        return {"scheduled": path, **self.apply_changes(self.spark.createDataFrame([(0, self._inside(path), "change")], schemas.CHANGES))}

    def _inside(self, path: str) -> str:
        """The path relative to the root; one that leaves the root is an error."""
        if "://" in path:
            if not path.startswith(self.cfg.watch_root + "/"):
                raise ConfigError(f"{path!r} lies outside the watched root")
            path = path[len(self.cfg.watch_root) + 1:]
        relative = os.path.relpath(path, self.cfg.watch_root) if os.path.isabs(path) else os.path.normpath(path)
        relative = relative.replace(os.sep, "/")
        if relative == ".." or relative.startswith("../"):
            raise ConfigError(f"{path!r} lies outside the watched root")
        return relative

    def remove(self, path: str) -> dict[str, int]:
        return self.apply_changes(self.spark.createDataFrame([(0, self._inside(path), "unlink")], schemas.CHANGES))

    def apply_changes(self, events: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """(seq, path, event): the last event of each path decides; a changed file that is gone is removed.

        Events whose path is absolute or has a `..` step name nothing inside the root and are left out. A ``batch``, (stream,
        number), that a version holds already changes nothing.
        """
        if self.is_applied(batch):
            return {}
        leaves = F.col("path").startswith("/") | F.concat(F.lit("/"), F.col("path"), F.lit("/")).contains("/../")
        last = changes.last_event_per_path(events.filter(~leaves))
        named = last.filter("event <> 'unlink'").select("path").filter(accepted(self.cfg))
        found = stat_files(named, self.cfg)
        missing = found.filter("size IS NULL").select("path")
        return self._index(found.filter("size IS NOT NULL"), last.filter("event = 'unlink'").select("path").unionByName(missing), batch=batch)

    # ---- reading -----------------------------------------------------------------------------------
    def search_tables(self) -> SearchTables | None:
        """The tables of the current version: a search does not see what is written meanwhile."""
        now = self.at()
        if not now.is_indexed():
            return None
        totals = now.table("bucket_stats").agg(F.sum("n_chunks").alias("n_docs"), F.sum("n_terms").alias("_terms"))
        stats = totals.select("n_docs", (F.col("_terms") / F.col("n_docs")).alias("avg_dl"))
        blocks = blockmax.added(now.table("term_df"))
        return SearchTables(now.table("chunks"), now.table("postings"), stats, self.cfg.path_buckets, blocks)

    def search_batch(self, queries: DataFrame, request: SearchRequest | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, query [, query_classifier]) -> (hits, assessment). The request filters the whole batch."""
        return self._run(with_vectors(queries, self.cfg), request or SearchRequest("*"))

    def _run(self, queries: DataFrame, request: SearchRequest, small: bool | None = None) -> tuple[DataFrame, DataFrame]:
        tables = self.search_tables()
        if tables is None:
            tables = SearchTables(self.table("chunks"), None, None)
        return search_plan(queries, tables, self.cfg, request, self.make_scorer, small)

    def search_requests(self, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(query_id, query [, query_classifier, path_prefix, ext, lang, glob, include_docs, limit]) -> (hits, assessment,
        rejected): searches of which each brings its own filters and limit."""
        tables = self.search_tables() or SearchTables(self.table("chunks"), None, None)
        return search_requests(with_vectors(requests, self.cfg), tables, self.cfg, self.make_scorer)

    def search(self, query: str, **arguments) -> DataFrame:
        """Hits of one query in order. Arguments are those of ``SearchRequest``."""
        request = SearchRequest(query, **arguments)
        hits, _ = self._run(queries_frame(self.spark, [request], self.cfg), request, small=True)
        return hit_payload(hits, self.cfg).orderBy("ord")

    def search_json(self, query: str, **arguments) -> str:
        """One query as the JSON document of the search tool; a rejected argument gives an error document."""
        try:
            request = SearchRequest(query, **arguments)
            queries = queries_frame(self.spark, [request], self.cfg)
            hits, assessment = self._run(queries, request, small=True)
        except ConfigError as error:
            return error_json(error)
        return result_json(hits, assessment, queries, self.cfg).first().payload

    def stats(self) -> DataFrame:
        """One row: root, number of files and chunks, model, time of the last write or scan."""
        now = self.at()
        meta = now.read_meta() or {}
        files = now.table("file_manifest").agg(F.count("*").alias("n")).scalar()
        chunks = now.table("bucket_stats").agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n")).scalar()
        one = self.spark.range(1)
        return one.select(
            F.lit(self.cfg.watch_root).alias("watch_root"), files.alias("indexed_file_count"), chunks.alias("chunk_count"),
            F.lit(meta.get("embedding_model") or self.cfg.embedding_model).alias("embedding_model"),
            F.lit(meta.get("last_full_scan_at")).cast(T.TimestampType()).alias("last_full_scan_at"),
        )

    def stats_json(self) -> str:
        row = self.stats().first().asDict()
        row["last_full_scan_at"] = row["last_full_scan_at"].isoformat() if row["last_full_scan_at"] else None
        return json.dumps(row, indent=2)
