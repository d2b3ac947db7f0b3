"""Changes that touch many paths: the same tables as by small steps, and texts made once for the listing and once for the chunks."""

from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.functions.paths import is_covered_by
from seekspark.plans import index as plans
from seekspark.plans.index import CodeIndex

TABLES = {"chunks": ["path", "start_line", "body", "dl"], "postings": ["path", "term", "tf", "dl"], "term_df": ["path_bucket", "term", "level", "df"],
          "file_manifest": ["path", "sha256"], "bucket_stats": ["path_bucket", "n_chunks", "n_terms"]}


def built(spark, place, texts):
    cfg = EngineConfig(watch_root="/x", embedding_dim=4, index_dir=str(place), path_buckets=3)
    index = CodeIndex(spark, cfg).open()
    older = texts.filter("n % 3 <> 1").withColumn("text", F.when(F.col("n") % 4 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    index.index_table(older.select("path", "text"))
    counts = index.index_table(texts.select("path", "text"))
    index.remove_table(texts.filter("n % 5 = 0").select("path"))
    return counts, {name: sorted(tuple(r) for r in index.table(name).select(*columns).collect()) for name, columns in TABLES.items()}


def test_many_touched_paths_give_the_same_tables(spark, tmp_path, monkeypatch):
    texts = spark.range(40).select(F.col("id").alias("n"), F.format_string("src/d%s.py", "id").alias("path"), F.format_string("def f%1$s():\n    w%1$s w1 w1", "id").alias("text"))
    few = built(spark, tmp_path / "few", texts)
    monkeypatch.setattr(plans, "MAX_TOUCHED", 2)
    assert built(spark, tmp_path / "many", texts) == few
    assert len(few[1]["file_manifest"]) == 32 and few[1]["postings"]


def test_texts_are_made_twice_at_most(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(number):
        made.add(1)
        return f"def f{number}():\n    return {number}"

    rows = spark.range(50).repartition(2).select(F.format_string("src/d%s.py", "id").alias("path"), text("id").alias("text")).repartition(3)
    index = CodeIndex(spark, EngineConfig(watch_root="/x", embedding_dim=4, index_dir=str(tmp_path / "i"), path_buckets=3)).open()
    assert index.index_table(rows)["indexed"] == 50
    assert made.value <= 100


def test_covered_paths_without_patterns(evaluate):
    rows = [("./.claude/docs/x.md", True), (".//.claude/docs//", True), (".claude\\docs\\a", True), (".claude/", True), ("./.claude", True), ("a/.claude/docs/x", False),
            (".claude/docsx", False), ("./", False), (".", False), ("docs/../.claude/docs", False), (".claude/docs", True)]
    assert evaluate([(p,) for p, _ in rows], "p string", is_covered_by(F.col("p"), (".claude/docs/",))) == [w for _, w in rows]
