"""Files of one directory are listed by one task and read by many."""

from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.sources import files
from seekspark.sources.stores import store_of


def test_one_directory_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 7)
    store = store_of(str(tmp_path / "tree"))
    for n in range(60):
        store.write(f"src/d{n}.py", f"x = {n}\n".encode())
    store.write(".gitignore", b"src/d3.py\n")
    cfg = EngineConfig(watch_root=str(tmp_path / "tree"), index_dir=str(tmp_path / "index"))
    listed, failed = files.walk_files(spark, cfg)
    assert failed.isEmpty() and {r.path for r in listed.collect()} == {f"src/d{n}.py" for n in range(60) if n != 3}
    found = files.read_texts(files.dealt_by_bytes(listed, 60 * 8), cfg).withColumn("task", F.spark_partition_id()).collect()
    assert {r.path: r.text for r in found} == {f"src/d{n}.py": f"x = {n}\n" for n in range(60) if n != 3}
    assert len({r.task for r in found}) >= 4
    # So are the tests of the listed paths.
    assert listed.select(F.input_file_name()).distinct().count() >= 4
