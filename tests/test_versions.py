"""Versions of the index: pinned readers, dead attempts, repeated paths."""

import os

import pytest
from pyspark.sql import functions as F

from seekspark.config import ConfigError, EngineConfig
from seekspark.plans.index import CodeIndex

DDL = "path string, text string, mtime_ms double"


@pytest.fixture
def index(spark, tmp_path):
    return CodeIndex(spark, EngineConfig(watch_root=str(tmp_path), index_dir=str(tmp_path / "index"), embedding_dim=8, path_buckets=2, cross_encoder_enabled=False)).open()


def texts(spark, *rows):
    return spark.createDataFrame([(p, t, m) for p, t, m in rows], DDL)


def state(reader):
    return {
        "bodies": sorted((r.path, r.body) for r in reader.table("chunks").collect()),
        "terms": sorted((r.path, r.term) for r in reader.table("postings").collect()),
        "blocks": reader.table("term_df").agg(F.sum("df")).first()[0],
        "files": sorted(r.path for r in reader.table("file_manifest").collect()),
        "chunks": reader.stats().first().chunk_count,
    }


def test_a_pinned_reader_sees_its_version(spark, index):
    index.index_table(texts(spark, ("a.py", "alpha beta", 1.0), ("b.py", "gamma", 1.0), ("c.py", "delta", 1.0)))
    reader, before = index.at(), state(index)
    assert index.version() == reader.pinned == 2 and before["files"] == ["a.py", "b.py", "c.py"]
    index.index_table(texts(spark, ("a.py", "alpha two", 2.0), ("d.py", "new", 1.0)))
    index.remove_table(spark.createDataFrame([("b.py",)], "path string"))
    after = state(index)
    assert state(reader) == before == state(index.at(2))
    assert after["files"] == ["a.py", "c.py", "d.py"] and ("a.py", "alpha two") in after["bodies"] and after["chunks"] == 3
    assert [r.path for r in reader.search("gamma", limit=1).collect()] == ["b.py"]
    assert "b.py" not in {r.path for r in index.search("gamma").collect()}
    with pytest.raises(ConfigError, match="does not write"):
        reader.index_table(texts(spark, ("e.py", "x", 1.0)))
    index.wipe()
    assert state(index)["bodies"] == [] and state(reader) == before


def test_what_a_dead_attempt_wrote_is_never_read(spark, index, monkeypatch):
    index.index_table(texts(spark, ("a.py", "alpha", 1.0)))
    before, write = state(index), CodeIndex._write

    def dying(self, frame, name, version, *order):
        write(self, frame, name, version, *order)
        if name == "term_df":
            raise OSError("lost")

    monkeypatch.setattr(CodeIndex, "_write", dying)
    with pytest.raises(OSError):
        index.index_table(texts(spark, ("a.py", "beta", 2.0), ("z.py", "left behind", 2.0)))
    assert state(index) == before
    monkeypatch.setattr(CodeIndex, "_write", write)
    assert index.index_table(texts(spark, ("a.py", "beta", 2.0)))["indexed"] == 1
    assert state(index)["bodies"] == [("a.py", "beta")] and state(index)["files"] == ["a.py"]


def test_of_repeated_paths_the_latest_counts(spark, index):
    rows = [("a.py", "first", 1.0), ("a.py", "last", 3.0), ("a.py", "last", 3.0), ("a.py", "none", None), ("b.py", None, 1.0)]
    assert index.index_table(texts(spark, *rows))["indexed"] == 2
    assert state(index)["bodies"] == [("a.py", "last"), ("b.py", "")]
    assert index.index_table(texts(spark, ("a.py", "last", 9.0)))["hash_skipped"] == 1
    assert index.index_table(texts(spark, ("a.py", "last", 9.0)))["stat_skipped"] == 1


def test_only_touched_buckets_are_written_anew(spark, index):
    index.index_table(texts(spark, *[(f"f{i}.py", f"text {i}", 1.0) for i in range(8)]))
    index.index_table(texts(spark, ("f1.py", "changed", 2.0)))
    assert len(os.listdir(os.path.join(index.cfg.index_dir, "chunks", "version=3"))) <= 4  # one bucket, _SUCCESS and its checksum
    held = index._folders("chunks")
    assert sorted(b for bs in held.values() for b in bs) == [0, 1] and len(held[3]) == 1
    assert len(state(index)["bodies"]) == 8
