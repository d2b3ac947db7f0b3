"""The stages against plain Python on the smallest table, and the cases that a stage must not lose."""

import itertools
import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from seekspark.llm import secrets
from seekspark.llm.mixing import MIX_SQL
from tests.llm.test_packing import check
from tests.llm.test_similar import likeness, plain_set

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def rows_of(frame):
    return [tuple(r) for r in frame.select(*corpus_pipeline.COLUMNS).collect()]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input, and the rows after each stage, written and read again as the driver does; some rows are made odd."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, "en", None, None), (9002, "", None, "src1", 0), (9003, "12 34 !!", "en", "src1", 8), (9004, "token: abcdefgh12345 in the house of the king", None, None, 44),
         (None, "an unnumbered text about the weather and the sea", "en", "src2", 48), (9005, "secret=0123456789ab the only one of its kind here", "en", "src3", 49)],
        base.schema)
    docs = base.unionByName(odd).unionByName(base.filter("doc_id = 3"))
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, out[-1], FOLDER)
        if i < 4:
            assert made.columns == corpus_pipeline.COLUMNS
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        made.write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_language_stage_drops_only_what_it_cannot_tell(steps):
    before, after = Counter(rows_of(steps[0])), Counter(rows_of(steps[1]))
    gone = before - after
    assert not after - before
    assert {r[0] for r in gone} == {9001, 9002, 9003}


def test_one_document_of_each_group_stays(steps):
    """Links are exact, and nearly all of them are found: what stays are all groups of brute force, and few rows more."""
    rows = [r for r in rows_of(steps[1]) if r[0] is not None]
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if likeness(sets[i], sets[j]) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    least = {}
    for i, row in enumerate(rows):
        least[find(i)] = min(least.get(find(i), row[0]), row[0])
    kept = Counter(r[0] for r in rows_of(steps[2]))
    assert max(kept.values()) == 1 and kept[None] == 1
    assert set(least.values()) <= set(kept)
    assert len(kept) - 1 - len(least) <= 0.05 * (len(rows) - len(least))


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [
        (1, text("a"), "en", "s", 1), (2, text("a"), "en", "s", 1), (2, text("b"), "en", "s", 1), (3, text("c"), "en", "s", 1),
        (3, text("d"), "en", "s", 1), (4, text("e"), "en", "s", 1), (4, text("e"), "en", "s", 1), (4, text("e"), None, "s", 1),
        *[(None, text("f"), "en", "s", 1)] * 5, (None, text("a"), "en", "s", 1), (None, text("g"), None, "en", 1), (None, text("g"), "en", None, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER))
    assert Counter((r[0], r[1][0]) for r in got) == Counter([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e"), (None, "f"), (None, "g")])
    again = rows_of(corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), FOLDER))
    assert Counter(got) == Counter(again)


def test_secrets_are_masked_and_nothing_else_changes(steps):
    want = Counter()
    for key, text, lang, source, n in rows_of(steps[2]):
        found = secrets.find_secrets(text)
        for _, start, end, _ in sorted(found, key=lambda s: -s[1]):
            text = text[:start] + "[SECRET]" + text[end:]
        want[key, text, lang, source, len(text) if found else n] += 1
    assert Counter(rows_of(steps[3])) == want
    assert not any("abcdefgh12345" in r[1] or "0123456789ab" in r[1] for r in rows_of(steps[3]))


def test_the_mix_takes_what_its_sql_says(steps):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows_of(steps[3]))
    copies = {r[0]: round(r[4] / r[1]) for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL})").fetchall()}
    want = Counter({r: copies[r[0]] for r in rows_of(steps[3])})
    assert Counter(rows_of(steps[4])) == +want


def test_packing_keeps_every_token(steps):
    from seekspark.llm import tokens

    maker = tokens.WordTokenizer(tokens.tokenizer_text())
    check(steps[5].collect(), [r[:2] for r in rows_of(steps[4])], maker, 4096)


def test_run_gives_the_last_stage(spark):
    random.seed(0)
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
