"""Ranked search against a plain count of every term in every text."""

import math
import random
import re
from collections import Counter

import pytest

from seekspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DDL = "doc_id long, text string, item_id string, score int, rank int, _item int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    n_docs, all_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for key, c in counted:
            score = 0
            for t in wanted & c.keys():
                m = 100 - 90 + 90 * c.total() * n_docs // all_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i, key, -s) for i, (s, _, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "été", "的", "İx", "A1", "a b", "x y"]
    text = lambda n: rng.choice([" ", ", ", "--", "\n"]).join(rng.choice(vocabulary[: rng.choice([5, 30, 67])]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "?! .."), (9, docs[9][1]), (9, "w1 w2"), (None, docs[10][1]), (None, docs[10][1]), (10, docs[10][1])]
    items = [(i, text(rng.choice([1, 4, 30]))) for i in range(30)] + [(50, None), (51, "!"), (52, "unheard of"), (None, "w3 w4"), (None, "W5"), (2, "w59"), (53, "w1 w1 W1")]
    return docs, items


def tables(spark, docs, items):
    return (spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in docs], DDL).repartition(5),
            spark.createDataFrame([(i, t, 7) for i, t in items], "item_id int, text string, doc_id int"))


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_a_plain_count(spark, monkeypatch, small):
    if small:  # many blocks, pieces and cuts
        for name, value in {"MAX_PAIRS": 60, "PIECE": 16, "CELLS": 64, "HELD": 32}.items():
            monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    got = lexical.search(*tables(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_counts_of_pieces_equal_those_of_the_whole(monkeypatch):
    rng = random.Random(1)
    known = ["a", "aa", "ab", "été", "b"]
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(lexical, "PIECE", size)
        for _ in range(300):
            text = "".join(rng.choice(["a", "b", "A", " ", "-", "é", "été", " ", "\t"]) for _ in range(rng.randint(0, 25)))
            total, numbers, counts = lexical.count_terms(text.encode(), lexical.automaton(known), len(known))
            want = Counter(terms(text))
            assert total == want.total()
            assert dict(zip(numbers.tolist(), counts.tolist(), strict=True)) == {i: want[t] for i, t in enumerate(known) if want[t]}


def test_long_texts_ties_and_empty_tables(spark):
    docs = [(1, "rare " + "common " * 1_500_000), (2, "rare"), (3, "rare"), (4, "common")] + [(i, "filler") for i in range(5, 40)]
    items = [(1, "rare Common"), (2, "nothing")]
    frame, asked = tables(spark, docs, items)
    assert sorted(map(tuple, lexical.search(frame, asked).collect()), key=str) == plain(docs, items)
    assert [r.doc_id for r in lexical.search(frame, asked, k=2).orderBy("rank").collect()] == [r[2] for r in plain(docs, items, 2)]
    assert lexical.search(frame.limit(0), asked).count() == 0
    assert lexical.search(frame, asked.limit(0)).count() == 0
