"""The sweep over the postings of a batch against the one pass, and the cheaper shared steps against their plain forms."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.functions.text import SPACE, trim
from seekspark.operators import blockmax, embedding, fulltext, sweep
from seekspark.sources.corpus import NOT_PLAIN


def corpus(spark, n=400):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 40))) for _ in range(n)]
    texts += [texts[5]] * 150 + ["w1 w2"] * 60  # copies tie by the hundred
    rows = [(f"c{i}#0", f"p{i % 3}", t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, text string").repartition(5).cache()
    queries = [(i, " ".join(rng.choices(words, k=1 + i % 7))) for i in range(23)] + [(100, "nothing here"), (101, ""), (102, "w1 w1 w2")]
    return chunks, spark.createDataFrame(queries, "query_id bigint, query string")


@pytest.mark.parametrize("rows,cells", [(1 << 17, 1 << 20), (64, 40)])
def test_a_sweep_gives_what_one_pass_gives(spark, monkeypatch, rows, cells):
    chunks, queries = corpus(spark)
    posted = fulltext.postings(chunks, F.col("text"), ("chunk_id", "path")).cache()
    stats, blocks = fulltext.corpus_stats(chunks, posted).cache(), blockmax.term_blocks(posted)
    monkeypatch.setattr(sweep, "ROWS", rows)
    monkeypatch.setattr(sweep, "CELLS", cells)
    taken = []
    monkeypatch.setattr(blockmax, "swept", lambda *a: taken.append(1) or sweep.swept(*a))
    for allowed in (None, F.col("path") != "p1"):
        for k in (1, 10, 700):
            got = []
            for least in (0, 1 << 60):
                monkeypatch.setattr(blockmax, "SWEEP_FROM", least)
                found = blockmax.best_chunks(queries, posted, stats, blocks, k, allowed=allowed).collect()
                got.append(sorted((r.query_id, r.ord, r.chunk_id, r.score) for r in found))
            assert got[0] and got[0] == got[1], k
    assert len(taken) == 6


def test_a_sweep_heeds_the_scopes_of_its_queries(spark, monkeypatch):
    chunks, queries = corpus(spark, 120)
    posted = fulltext.postings(chunks, F.col("text"), ("chunk_id", "path")).cache()
    stats, blocks = fulltext.corpus_stats(chunks, posted).cache(), blockmax.term_blocks(posted)
    accepted = F.filter(F.array(F.lit(3), F.when(F.col("path") == "p1", 7), F.when(F.col("path") == "p2", 1)), lambda s: s.isNotNull())
    scoped = posted.withColumn("scopes", accepted)
    asked = queries.withColumn("scope_id", F.element_at(F.array(F.lit(3), F.lit(7), F.lit(1), F.lit(9)), (F.col("query_id") % 4 + 1).cast("int")))
    got = []
    for least in (0, 1 << 60):
        monkeypatch.setattr(blockmax, "SWEEP_FROM", least)
        found = blockmax.best_chunks(asked, scoped, stats, blocks, 8, scoped=True).collect()
        got.append(sorted((r.query_id, r.ord, r.chunk_id, r.score) for r in found))
    assert got[0] and got[0] == got[1]


def test_postings_count_every_term_of_a_chunk(spark, monkeypatch):
    rows = [(1, "B a a_1 A\nb-b"), (2, ""), (3, None), (4, "é ü"), (5, "x " * 5000), (6, "one")]
    frame = spark.createDataFrame(rows, "chunk_id int, text string").coalesce(1)
    monkeypatch.setattr(fulltext, "TERMS", 3)
    got = sorted(tuple(r) for r in fulltext.postings(frame, F.col("text")).select("chunk_id", "term", "tf", "dl").collect())
    assert got == [(1, "a", 2, 6), (1, "a_1", 1, 6), (1, "b", 3, 6), (5, "x", 5000, 5000), (6, "one", 1, 1)]


def test_cheaper_steps_give_the_same(evaluate):
    odd = [" \t\n\x0b\f\r", "\xa0  a b  ", "​a", "", None, "x  ﻿", "\x1ca", "é　", "𝒳 -_`{~\x7f[]@:/!Z9"]
    assert evaluate([(t,) for t in odd], "t string", trim(F.col("t"))) == evaluate([(t,) for t in odd], "t string", F.regexp_replace("t", f"^{SPACE}+|{SPACE}+\\z", ""))
    every = [("".join(map(chr, range(0x300))) + "𝒳￿",)]
    assert evaluate(every, "t string", F.regexp_replace("t", NOT_PLAIN, " ")) == evaluate(every, "t string", F.regexp_replace("t", "[^A-Za-z0-9 ]", " "))


def test_the_stand_in_embedder_counts_signed_terms():
    def plain(text, dim):
        out = np.zeros(dim)
        for term in re.findall("[a-z0-9_]+", text.lower()):
            value = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
            out[value % dim] += 1 if (value // dim) % 2 == 0 else -1
        return out

    texts = ["a b c a", "", "Über x_1 " * 50, " ".join(f"t{i}" for i in range(300))]
    assert np.array_equal(embedding.hashing_embedder(7)(texts), embedding.unit_rows(np.array([plain(t, 7) for t in texts])))
