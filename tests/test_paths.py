import pytest
from pyspark.sql import functions as F

from seekspark.config import ConfigError
from seekspark.functions import globs, paths

def P():
    return F.col("path")


def test_globs(evaluate):
    cases = [
        ("*.rb", "a/b/c.rb", True), ("*.rb", ".x.rb", True), ("src/*.ts", "src/a/b.ts", False), ("src/**/*.ts", "src/b.ts", True),
        ("**/x.py", "x.py", True), ("*.{js,ts}", "a/b.ts", True), ("f{1..3}.txt", "f2.txt", True), ("[!a]*.c", "abc.c", False),
        ("!(*test*).js", "mytest.js", False), ("!(*test*).js", "my.js", True), ("a?c", "abc", True), ("docs/**", "docs/a/b", True),
        ("@(a|b).md", "b.md", True), ("+(ab).md", "abab.md", True),
    ]
    for pattern, path, expected in cases:
        assert evaluate([(path,)], "path string", paths.glob_predicate(P(), pattern)) == [expected], (pattern, path)
    with pytest.raises(ConfigError):
        globs.glob_to_regex("@(a")


def test_ignore_rules(evaluate):
    lines = ["*.log", "!keep.log", "/build", "tmp/", "docs/**/x.md", "# note", "\\#odd"]
    rows = [("a/b.log", True), ("keep.log", False), ("build/x", True), ("a/build/x", False), ("a/tmp/y", True), ("tmp", False),
            ("docs/x.md", True), ("docs/a/x.md", True), ("tmp/keep.log", True), ("#odd", True), ("src/a.ts", False), ("", False)]
    got = evaluate([(p,) for p, _ in rows], "path string", globs.ignored(P(), lines))
    assert got == [e for _, e in rows]


def test_buckets_and_labels(evaluate):
    rows = [(".env", "config"), (".env.local", "config"), ("prod.env", "code"), ("README.txt", "docs"), ("notes.txt", "code"),
            ("a.MD", "docs"), ("x/y.toml", "config"), (".claude/docs/a.rb", "docs"), (".claude", "docs"), ("a/b.rb", "code")]
    assert evaluate([(p,) for p, _ in rows], "path string", paths.content_bucket(P(), (".claude/docs",))) == [b for _, b in rows]
    assert evaluate([("Makefile",), ("a.pyc",), ("LICENSE",), ("x",), (".rb",), ("a.b.py",)], "path string", paths.is_indexable(P())) == [
        True, False, True, False, False, True]


def test_prefix_covers_directory_but_not_siblings(evaluate):
    rows = [("lib",), ("lib/a",), ("library/a",), ("li",)]
    assert evaluate(rows, "path string", paths.prefix_predicate(P(), " lib\\ ")) == [True, True, False, False]


def test_unknown_language():
    with pytest.raises(ConfigError):
        paths.query_path_predicate(P(), lang="klingon")


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("lib/a",), ("src/b",)], "path string").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t")).filter(paths.prefix_predicate(P(), "lib"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,lib/)" in plan
