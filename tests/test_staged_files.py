"""Files that were read are staged by bucket, small, and their texts are not dealt out again."""

from pathlib import Path

import pyarrow.parquet as pq

from seekspark.config import EngineConfig
from seekspark.plans.index import CodeIndex
from seekspark.session import shared_folder
from seekspark.sources.stores import store_of


def test_files_are_staged_by_bucket(spark, tmp_path, monkeypatch):
    store = store_of(str(tmp_path / "tree"))
    for n in range(30):
        store.write(f"src/d{n}.py", f"def f{n}():\n    return {n}\n".encode())
    dealt, shared, kind = [], Path(shared_folder(spark)), type(spark.range(0))
    by_id = kind.repartitionById

    def seen(self, tasks, key):
        dealt.append(self.columns)
        return by_id(self, tasks, key)

    monkeypatch.setattr(kind, "repartitionById", seen)
    index = CodeIndex(spark, EngineConfig(watch_root=str(tmp_path / "tree"), index_dir=str(tmp_path / "index"), embedding_dim=4, path_buckets=2)).open()
    before = set(shared.glob("staging-*"))
    assert index.full_scan()["indexed"] == 30
    store.write("src/d3.py", b"changed = 1\n")
    assert index.reconcile()["indexed"] == 1
    staged = [file for folder in set(shared.glob("staging-*")) - before for file in folder.glob("files/path_bucket=*/*.parquet")]
    assert len({file.parent.name for file in staged}) == 2
    assert {pq.ParquetFile(file).metadata.row_group(0).column(0).compression for file in staged} == {"ZSTD"}
    assert dealt and not any("text" in columns for columns in dealt)
    bodies = {r.path: r.body for r in index.table("chunks").filter("start_line = 1").collect()}
    assert len(bodies) == 30 and bodies["src/d3.py"].startswith("changed") and bodies["src/d7.py"].startswith("def f7")
