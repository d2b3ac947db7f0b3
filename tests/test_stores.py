"""A mounted folder and the same folder by URI give the same entries and bytes."""

import os

import pytest

from seekspark.config import ConfigError, EngineConfig
from seekspark.plans.index import CodeIndex
from seekspark.sources.stores import MountedStore, UriStore, store_of

FILES = {"a b.py": b"x = 1\n", ".hidden/_p/__init__.py": b"caf\xe9", "d/e/f.gz": b"\x1f\x8b not compressed", "empty.md": b"", "d/%41#ü.txt": "é".encode()}


def test_stores_agree(tmp_path):
    root = tmp_path / "tree"
    mounted, remote = store_of(str(root)), store_of(f"file://{root}")
    assert isinstance(mounted, MountedStore) and isinstance(remote, UriStore)
    for number, (path, content) in enumerate(FILES.items()):
        (mounted, remote)[number % 2].write(path, content)
    for path, content in FILES.items():
        assert mounted.read(path) == remote.read(path) == content
        assert remote.stat(path)[0] == mounted.stat(path)[0] == len(content)
        assert abs(remote.stat(path)[1] - mounted.stat(path)[1]) < 1
    rounded = lambda rows: sorted((p, n, round(m), d, e) for p, n, m, d, e in rows)
    for folder in ("", "d", "d/e", ".hidden", ".hidden/_p"):
        assert rounded(mounted.entries(folder)) == rounded(remote.entries(folder))
    for store in (mounted, remote):
        assert store.stat("none") is None and store.stat("d") is None
        with pytest.raises(OSError):
            store.read("none")
        with pytest.raises(OSError):
            store.entries("none")


def test_a_tree_by_uri_is_indexed(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    store = store_of(root)
    for path, content in {"src/a.py": b"def f():\n    pass\n", ".gitignore": b"gone/\n", "gone/b.py": b"x", "_p/c.md": b"caf\xe9"}.items():
        store.write(path, content)
    index = CodeIndex(spark, EngineConfig(watch_root=root, index_dir=str(tmp_path / "index"), embedding_dim=8, path_buckets=1)).open()
    assert index.full_scan()["indexed"] == 2
    assert {r.path: r.body for r in index.table("chunks").collect()} == {"src/a.py": "def f():\n    pass\n", "_p/c.md": "caf�"}
    os.remove(tmp_path / "tree/_p/c.md")
    store.write("src/a.py", b"y = 2\n")
    assert index.reindex(f"{root}/src/a.py")["indexed"] == 1
    assert index.reconcile()["removed"] == 1
    with pytest.raises(ConfigError):
        index.reindex("file:///elsewhere/a.py")
