"""Corpora derived from the document tables: repository paths for every text, and source files.

Each row of the table becomes one file holding its whole text, so the corpora grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# All but ASCII letters, digits and spaces. Java matches a negated class of several ranges an order of magnitude slower.
NOT_PLAIN = r"[\x00-\x1F!-/:-@\[-`{-\x{10FFFF}]"
EPOCH_MS = 1_700_000_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deals a small input out to all tasks: one Parquet row group is one task, however heavy its texts.

    Inputs of more pieces than there are tasks, or of files for half of the tasks, stay as they are, without a shuffle of all texts.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    enough = 2 * len(rows.inputFiles()) >= tasks or rows.rdd.getNumPartitions() >= 2 * tasks
    return rows if enough else rows.repartition(tasks)


def _pick(key: Column, choices: list[Column]) -> Column:
    out = None
    for number, choice in enumerate(choices):
        out = (F if out is None else out).when(key % len(choices) == number, choice)
    return out


def _name(template: str, doc_id: Column, source: Column) -> Column:
    return F.format_string(template.replace("{d}", "%1$s").replace("{s}", "%2$s"), doc_id, source)


FILE_PATHS = (
    "src/{s}/d{d}.ts", "lib/{s}/d{d}.rb", "spec/{s}/d{d}_spec.rb", "docs/{s}/d{d}.md", "config/{s}/d{d}.yml",
    "app/javascript/components/d{d}.tsx", ".claude/docs/d{d}.md", "test/fixtures/d{d}.json",
)
VARIED_PATHS = (
    "app/models/{s}/d{d}.rb", "node_modules/{s}/d{d}.js", "keys/d{d}.pem", "{s}/Dockerfile", "config/d{d}.env",
    ".env", "docs/d{d}/README.txt", "assets/{s}/d{d}.css", "web/client/d{d}.vue", "config/locales/d{d}.yaml",
    "infra/{s}/d{d}.tfvars", "src/types/d{d}.d.ts", "{s}/LICENSE", "img/d{d}.PNG", "d{d}.lock", "build/{s}/d{d}.java",
    "vendor/{s}/d{d}.go", "Rakefile", "src/__tests__/d{d}.test.tsx", "notes/d{d}", ".claude/docs/{s}/d{d}.md",
    "packages/ui/d{d}.scss", "deploy/prod.env.local", "pkg/d{d}.rs",
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, text, size, mtime_ms."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    path = _pick(F.col("doc_id"), [_name(t, F.col("doc_id"), F.col("source")) for t in FILE_PATHS])
    return docs.select(
        "doc_id", path.alias("path"), "text", F.length("text").cast("bigint").alias("size"),
        (F.lit(EPOCH_MS) + F.col("doc_id")).alias("mtime_ms"),
    )


def varied_paths(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path: every kind of path the filters know."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return docs.select(
        "doc_id", _pick(F.col("doc_id"), [_name(t, F.col("doc_id"), F.col("source")) for t in VARIED_PATHS]).alias("path")
    )


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the web pages."""
    return table(spark, folder, "pages").select(
        F.format_string("web/p%s.html", F.col("page_id")).alias("path"), F.col("html").alias("text")
    )


# Per language: path, first line, what one text line turns into, last line. {w} is a name made of the
# line, {l} its plain words, {d} the document.
SOURCES = (
    ("gen/d{d}.ts", "export class D{d} {", "  {w}(a) {\n    return \"{l}\";\n  }", "}"),
    ("gen/d{d}.py", "class D{d}:", "    def {w}(self):\n        return \"{l}\"", None),
    ("gen/d{d}.rb", "class D{d}", "  def {w}\n    \"{l}\"\n  end", "end"),
    ("gen/d{d}.go", "package gen", "func {w}() {\n\treturn \"{l}\"\n}", None),
    ("gen/D{d}.java", "class D{d} {", "  String {w}() {\n    return \"{l}\";\n  }", "}"),
    ("gen/d{d}.rs", "use std::fmt;", "fn {w}() {\n    \"{l}\"\n}", None),
    ("gen/d{d}.yml", "# generated", "{w}: {l}\n  - {l}", None),
    ("gen/d{d}.json", "{", "  \"{w}\": {\"k\": \"} {l}\"},", "}"),
)


def source_files(spark: SparkSession, folder: str, form: int | None = None) -> DataFrame:
    """doc_id, path, text: each document rewritten as a source or config file, line by line.

    Each eighth of the documents takes one form; a number gives all of them that form.
    """
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.split("text", r"\r?\n").alias("_lines"))
    number = F.col("doc_id").cast("string")

    def fill(template: str, word: Column, plain: Column) -> Column:
        out = F.lit(template)
        for mark, value in (("{d}", number), ("{w}", word), ("{l}", plain)):
            if mark in template:
                out = F.replace(out, F.lit(mark), value)
        return out

    def body(template: str) -> Column:
        def one(line: Column, i: Column) -> Column:
            plain = F.regexp_replace(line, NOT_PLAIN, " ")
            word = F.concat(F.lower(F.regexp_extract(line, "([A-Za-z]+)", 1)), F.lit("_"), i.cast("string"))
            return fill(template, word, plain)

        return F.transform("_lines", one)

    def text(first: str, template: str, last: str | None) -> Column:
        none = F.lit("")
        parts = [F.array(fill(first, none, none)), body(template)] + ([F.array(F.lit(last))] if last else [])
        return F.array_join(F.concat(*parts), "\n")

    key = F.col("doc_id") if form is None else F.lit(form)
    return docs.select(
        "doc_id",
        _pick(key, [fill(p, F.lit(""), F.lit("")) for p, *_ in SOURCES]).alias("path"),
        _pick(key, [text(*rest) for _, *rest in SOURCES]).alias("text"),
    )
