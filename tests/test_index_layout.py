"""What an index writes lies by bucket where it is made: chunks are not dealt out again, postings come sorted, touched paths are found by hash."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.operators import changes, fulltext
from seekspark.plans import index as plans
from seekspark.plans.index import CodeIndex


def texts(spark, old):
    said = F.when(F.col("id") % 3 == 0, F.format_string(f"w%1$s w1 w1 {old}", "id")).otherwise(F.format_string("w%1$s w1 w2 x%1$s", "id"))
    return spark.range(60).repartition(3).select(F.format_string("src/d%s.py", "id").alias("path"), said.alias("text"))


def built(spark, place):
    index = CodeIndex(spark, EngineConfig(watch_root="/x", embedding_dim=4, index_dir=str(place), path_buckets=3)).open()
    index.index_table(texts(spark, "old"))
    index.index_table(texts(spark, "new"))
    index.remove_table(texts(spark, "new").select("path").filter("path LIKE '%7.py'"))
    return {name: sorted(map(tuple, index.table(name).select(*columns).collect())) for name, columns in (
        ("chunks", ["path", "body", "dl"]), ("postings", ["path", "term", "tf", "dl"]), ("file_manifest", ["path", "sha256"]))}


def expected():
    rows = {f"src/d{i}.py": f"w{i} w1 w1 new" if i % 3 == 0 else f"w{i} w1 w2 x{i}" for i in range(60) if i % 10 != 7}
    return sorted((path, text, len(f"{path} {path.split('/')[1]} {path.split('/')[1]} {path}".replace("/", " ").replace(".", " ").split()) + 4) for path, text in rows.items())


@pytest.mark.parametrize("touched, hashed, alike", [(100_000, 4_000_000, False), (0, 4_000_000, True), (0, 0, False)])
def test_rows_of_chunks_stay_where_they_lie(spark, tmp_path, monkeypatch, touched, hashed, alike):
    kind, dealt, hash_of = type(spark.range(0)), [], changes.hash_of
    hint, plain = kind.hint, spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)

    def seen(self, name, *parameters):
        dealt.append((name, self.columns))
        return hint(self, name, *parameters)

    monkeypatch.setattr(kind, "hint", seen)
    monkeypatch.setattr(plans, "MAX_TOUCHED", touched)
    monkeypatch.setattr(plans, "MAX_HASHED", hashed)
    if alike:  # other paths share hashes with the touched ones
        monkeypatch.setattr(changes, "hash_of", lambda *columns: F.pmod(hash_of(*columns), F.lit(5)))
    found = built(spark, tmp_path)
    assert found["chunks"] == expected() and len(found["file_manifest"]) == 54
    assert sum(tf for *_, tf, _ in found["postings"]) == sum(n for *_, n in found["chunks"])
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == plain
    for file in tmp_path.glob("postings/version=*/path_bucket=*/*.parquet"):
        terms = pq.ParquetFile(file).read(["term"])["term"].to_pylist()
        assert terms == sorted(terms) and len(set(terms)) > 1
    moved = any(name == "rebalance" and "vector" in columns for name, columns in dealt)
    assert moved == (hashed == 0 or alike)


def test_runs_of_postings_hold_what_plain_ones_hold(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "RUN", 4)
    monkeypatch.setattr(fulltext, "PASSED_ON", 3)
    rows = [(f"c{i}", i // 7 % 2, " ".join(f"t{(i * j) % 11}" for j in range(i % 6))) for i in range(40)]
    frame = spark.createDataFrame(rows, "chunk_id string, b int, text string").coalesce(1)
    columns = ["chunk_id", "b", "term", "tf", "dl"]
    plain = fulltext.postings(frame, F.col("text"), ("chunk_id", "b")).select(*columns).collect()
    runs = fulltext.postings(frame, F.col("text"), ("chunk_id", "b"), runs_of="b").select(*columns).collect()
    assert sorted(map(tuple, runs)) == sorted(map(tuple, plain)) and plain


def test_lengths_of_texts(evaluate):
    rows = [("a b_1 c",), ("",), (None,), ("É9 x",), ("-- ",)]
    assert evaluate(rows, "t string", fulltext.term_count(F.col("t"))) == [3, 0, 0, 2, 0]
