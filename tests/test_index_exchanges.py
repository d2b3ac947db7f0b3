"""Tables that follow from the chunks of an index are written where the chunks lie."""

from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.operators import blockmax
from seekspark.plans.index import CodeIndex


def texts(spark, old):
    said = F.when(F.col("id") % 3 == 0, F.format_string(f"w%1$s w1 w1 {old}", "id")).otherwise(F.format_string("w%1$s w1 w2 x%1$s", "id"))
    return spark.range(60).repartition(3).select(F.format_string("src/d%s.py", "id").alias("path"), said.alias("text"))


def test_postings_and_counts_take_no_exchange(spark, tmp_path, monkeypatch):
    plans, write = {}, CodeIndex._write

    def seen(self, frame, name, version, *order):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        write(self, frame, name, version, *order)
        files = {n: len(list((tmp_path / "i" / n / f"version={version}").glob("path_bucket=*/*.parquet"))) for n in ("chunks", name)}
        if name in ("postings", "term_df"):  # as few files as the chunks have
            assert 0 < files[name] <= files["chunks"]

    monkeypatch.setattr(CodeIndex, "_write", seen)
    index = CodeIndex(spark, EngineConfig(watch_root="/x", embedding_dim=4, index_dir=str(tmp_path / "i"), path_buckets=3)).open()
    for old in ("old", "new"):
        index.index_table(texts(spark, old))
        assert "Exchange" not in plans["postings"] and "Exchange" not in plans["term_df"]
    posted = index.table("postings")
    assert posted.filter("term = 'old'").isEmpty() and posted.filter("term = 'new'").count() == 20
    key = ["path_bucket", "term", "level"]
    found = {tuple(r) for r in blockmax.added(index.table("term_df"), "path_bucket").select(*key, "df", "max_tf", "min_dl").collect()}
    assert found == {tuple(r) for r in blockmax.term_blocks(posted, "path_bucket").select(*key, "df", "max_tf", "min_dl").collect()}


def test_counts_of_tasks_add_up(spark, monkeypatch):
    posted = spark.range(3000).select(
        F.format_string("t%s", F.col("id") % 70).alias("term"), (1 + F.col("id") % 5).alias("tf"), (9 + F.col("id") % 200).alias("dl")).repartition(3)
    columns = ["term", "level", "df", "max_tf", "min_dl"]
    expected = sorted(map(tuple, blockmax.term_blocks(posted).select(*columns).collect()))
    for rows in (50, 400, 1 << 21):
        monkeypatch.setattr(blockmax, "ROWS", rows)
        assert sorted(map(tuple, blockmax.added(blockmax.term_counts(posted)).select(*columns).collect())) == expected
    assert blockmax.term_counts(posted.limit(0)).isEmpty()
