"""Held-out accuracy, the defined cases, and scores against a plain computation."""

import math
import os
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.llm import language
from seekspark.llm.language import LanguageConfig

FOLDER = "/root/testdata/sf0.01"
WORDS = {"aa": "ka ke ki ko mara tele".split(), "bb": "zu zo zi wrx qpt lumm".split(), "cc": "ñandú ç éa über straße".split()}
DDL = "doc_id long, text string, lang string, lang_pred string, score string"


def rows_of(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang, "clash", "clash"))
    return out


def test_learned_languages_and_cases(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 300)
    odd = [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "123 !?", "bb", None, None), (1003, "KA KE KI", None, None, None),
           (None, "zu zo zi", "bb", None, None), (5, rows[5][1], rows[5][2], None, None), (1004, "mara tele " * 400_000, None, None, None)]
    frame = spark.createDataFrame(rows + odd, DDL).repartition(3)
    got = {}
    for r in language.identify(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(len(x) for x in got.values()) == len(rows) + len(odd) and len(got[5]) == 2
    for key, _, lang, *_ in rows:
        assert got[key][0].lang_pred == lang and 0.9 < got[key][0].score <= 1
    assert [(got[k][0].lang_pred, got[k][0].score) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0].lang_pred == got[1004][0].lang_pred == "aa" and got[None][0].lang_pred == "bb" and got[None][0].held_out is False
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, rs in got.items() if k is not None for r in rs)
    assert language.identify(frame.limit(0)).count() == 0
    unlabelled = language.identify(frame.withColumn("lang", frame.lang_pred.substr(0, 0)).filter("doc_id < 3").drop("lang").selectExpr("*", "cast(null as string) as lang"))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


def test_batches_change_nothing_and_scores_are_posteriors(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame(rows_of(rng, 200), DDL)
    model = language.fit(frame)
    texts = [None, "ka zu", "", "k", "ka ke zu zo ñandú", "mara"] + [r[1] for r in rows_of(rng, 30)]
    together = language.score_texts(texts, model)
    for i, text in enumerate(texts):
        langs, scores = language.score_texts([text], model)
        assert langs[0] == together[0][i] and abs(scores[0] - together[1][i]) < 1e-9
        if langs[0] == "und":
            continue
        codes = language._codes(text)
        sums = sum(model.weights[b] for o in model.config.orders for b in language._buckets(codes, o, model.config.bits))
        likely = np.exp(sums - sums.max())
        assert math.isclose(scores[0], likely.max() / likely.sum(), rel_tol=1e-9) and model.langs[int(sums.argmax())] == langs[0]


def test_the_sample_is_bounded(spark):
    rows = [(i, "ka ke ki", "aa", None, None) for i in range(5000)]
    few = language.fit(spark.createDataFrame(rows, DDL), config=LanguageConfig(rows_per_lang=100))
    assert few.langs == ["aa"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right, n = judged.filter("lang = lang_pred").count(), judged.count()
    assert n > 100 and right >= 0.98 * n


def test_texts_of_any_length_are_scored_in_bounded_memory():
    config = language.LanguageConfig()
    rng = np.random.default_rng(1)
    model = language.LanguageModel([f"l{i}" for i in range(64)], np.vstack([rng.normal(size=(1 << config.bits, 64)), np.zeros((1, 64))]), config)
    long = "the quick brown fox " * 100_000
    tracemalloc.start()
    langs, scores = language.score_texts(["short text", long, None], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all n-grams at once would take 1 GB
    assert langs[1] != "und" and langs[2] == "und" and 0 < scores[1] <= 1
    assert language.score_texts([long], model)[0] == langs[1:2]


def test_without_labels_every_text_with_a_letter_stays(spark):
    rows = [(1, "some words", None), (2, "", None), (3, None, None), (4, "12 !", None), (None, "été", None), (2, "x", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.text for r in language.keep_identified(unlabelled, ["doc_id", "text"]).collect()) == ["some words", "x", "été"]
