import json
import os

import pytest
from pyspark.sql import functions as F

from seekspark.config import ConfigError, EngineConfig
from seekspark.operators.changes import last_event_per_path
from seekspark.plans.index import CodeIndex
from seekspark.sources.files import not_below
from seekspark.streaming.watch import change_events, diff_events, start_watching

FILES = {
    "src/user_service.py": "class UserService:\n    def load(self):\n        return 1\n",
    "docs/guide.md": "# Guide\nHow to use the user service\n", "lib/a.rb": "class Foo\n  def bar\n  end\nend\n",
    "node_modules/x.js": "1", ".claude/docs/w.md": "working user notes", "_p/__init__.py": "x = 1\n", "a.lock": "x",
    ".gitignore": "ignored/\n", "ignored/z.py": "z=1", "bad.txt": b"caf\xe9",
}


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as handle:
        handle.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def index(spark, tmp_path):
    root = str(tmp_path / "repo")
    for path, text in FILES.items():
        put(root, path, text)
    return CodeIndex(spark, EngineConfig(watch_root=root, embedding_dim=32, path_buckets=2, rerank_debug_scores=True)).open()


def contents(index):
    return sorted((r.path, r.body) for r in index.table("chunks").select("path", "body").collect())


def test_scan_search_and_reconcile(index):
    assert index.search("user").collect() == []
    none = {"hash_skipped": 0, "failed": 0, "stat_skipped": 0, "too_large": 0, "unlisted": 0, "removed": 0}
    assert index.full_scan() == {**none, "indexed": 6}
    before = contents(index)
    assert {p for p, _ in before} == {"src/user_service.py", "docs/guide.md", "lib/a.rb", ".claude/docs/w.md", "_p/__init__.py", "bad.txt"}
    assert ("bad.txt", "caf�") in before
    top = index.search("find UserService", limit=3).collect()
    assert top[0].path == "src/user_service.py" and top[0].definition_of == "UserService"
    assert all(not r.path.startswith(".claude") for r in index.search("working notes").collect())
    assert index.search("working notes", include_docs=True).first().path == ".claude/docs/w.md"
    assert json.loads(index.search_json("x", lang="nope"))["ok"] is False

    root = index.cfg.watch_root
    put(root, "lib/a.rb", "class Foo2\nend\n")
    os.utime(os.path.join(root, "bad.txt"), (1, 1))
    os.remove(os.path.join(root, "docs/guide.md"))
    put(root, "big.txt", "x" * (index.cfg.max_file_bytes + 1))
    assert index.reconcile() == {**none, "indexed": 1, "hash_skipped": 1, "stat_skipped": 3, "too_large": 1, "removed": 1}
    assert index.reconcile()["indexed"] == 0
    after = contents(index)
    assert ("lib/a.rb", "class Foo2\nend\n") in after and not any(p == "docs/guide.md" for p, _ in after)
    row = index.stats().first()
    assert (row.indexed_file_count, row.chunk_count) == (5, len(after))
    posted = index.table("postings").agg(F.sum("tf")).first()[0]
    assert posted == index.table("bucket_stats").agg(F.sum("n_terms")).first()[0]

    changed = CodeIndex(index.spark, EngineConfig(watch_root=root, embedding_dim=16, path_buckets=2)).open()
    assert contents(changed) == []


def test_what_cannot_be_listed_is_not_removed(index, monkeypatch):
    index.full_scan()
    before, root = contents(index), index.cfg.watch_root
    os.rename(root, root + ".away")
    with pytest.raises(Exception, match="root cannot be listed"):
        index.reconcile()
    os.rename(root + ".away", root)
    assert contents(index) == before
    # A directory that is listed but fails: replaced in between by what scandir cannot read.
    rows = index.spark.createDataFrame([("lib/a.rb",), ("lib2/b.rb",), ("x",)], "path string")
    failed = index.spark.createDataFrame([("lib", "denied"), ("x", "denied")], "path string, error string")
    assert [r.path for r in not_below(rows, failed).collect()] == ["lib2/b.rb"]


def test_paths_outside_the_root_are_rejected(index):
    put(os.path.dirname(index.cfg.watch_root), "outside.md", "secret")
    for path in ("../outside.md", "src/../../outside.md", os.path.join(os.path.dirname(index.cfg.watch_root), "outside.md")):
        with pytest.raises(ConfigError):
            index.reindex(path)
    events = index.spark.createDataFrame([(1, "../outside.md", "add"), (2, "src/../../outside.md", "change"), (3, "/outside.md", "add")], "seq bigint, path string, event string")
    assert index.apply_changes(events)["indexed"] == 0 and contents(index) == []
    assert index.reindex("src/./user_service.py")["indexed"] == 1


@pytest.mark.parametrize("cuts", [[3], [1, 2]])
def test_stream_in_any_batches_gives_the_same_table(index, tmp_path, cuts):
    root, folder = index.cfg.watch_root, tmp_path / "events"
    folder.mkdir()
    index.full_scan()
    put(root, "n.txt", "new file")
    put(root, "lib/a.rb", "class Other\nend\n")
    os.remove(os.path.join(root, "bad.txt"))
    events = [(1, "n.txt", "add"), (2, "docs/guide.md", "change"), (3, "docs/guide.md", "unlink"), (4, "lib/a.rb", "change"),
              (5, "bad.txt", "change"), (6, "vendor/x.rb", "add"), (7, "gone.txt", "add")]
    bounds = [0, *cuts, len(events)]
    for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
        (folder / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "path", "event"), e))) for e in events[a:b]))
    stream = change_events(index.spark, str(folder), index.cfg, max_files=1)
    start_watching(index, stream, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert {p: b for p, b in contents(index)} == {
        "n.txt": "new file", "lib/a.rb": "class Other\nend\n", "src/user_service.py": "class UserService:",
        ".claude/docs/w.md": "working user notes", "_p/__init__.py": "x = 1\n",
    }


def test_events_fold_and_polling_diff(spark):
    events = spark.createDataFrame([(1, "a", "add"), (2, "a", "unlink"), (3, "a", "unlinkDir"), (1, "b", "change")], "seq bigint, path string, event string")
    assert {(r.path, r.event) for r in last_event_per_path(events).collect()} == {("a", "unlink"), ("b", "change")}
    now = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, 1.0)], "path string, size bigint, mtime_ms double")
    known = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("d", 1, 1.0)], "path string, size bigint, mtime_ms double")
    assert {(r.path, r.event) for r in diff_events(now, known).collect()} == {("b", "change"), ("c", "add"), ("d", "unlink")}


@pytest.mark.parametrize("strict", [False, True])
def test_a_table_may_hold_texts_of_any_length(spark, tmp_path, strict):
    cfg = EngineConfig(watch_root=str(tmp_path), index_dir=str(tmp_path / "index"), max_file_bytes=1000, strict_size=strict)
    index = CodeIndex(spark, cfg).open()
    for word in ("first", "second"):
        long = "\n".join(f"{word} {i}" for i in range(500))
        done = index.index_table(spark.createDataFrame([("a.txt", long), ("b.txt", "short")], "path string, text string"))
        assert done["too_large"] == 0 and done["failed"] == 0
        bodies = [r.body for r in index.table("chunks").filter("path = 'a.txt'").collect()]
        assert any(f"{word} 499" in b for b in bodies) and (word == "first" or not any("first" in b for b in bodies))
        assert {r.path for r in index.table("file_manifest").collect()} == {"a.txt", "b.txt"}
