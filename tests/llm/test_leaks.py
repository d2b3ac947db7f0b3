"""Decontamination against a plain search of every window in every text, and what is left after removal."""

import hashlib
import random
import re

import pytest

from seekspark.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DDL = "doc_id long, text string, n_words string, hits int, item_id long, _row int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add("null" if item is None else str(item))
    out = []
    for key, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), hit))
    return out


def tables(spark, docs, items):
    return (spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in docs], DDL),
            spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, words string"))


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = "alpha Beta g1 delta ÉTÉ été x9 ß 的 word".split()
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "?!"), (None, text(12)), (3, text(14)), (60, items[5][1]), (61, items[5][1].upper())]
    docs = []
    for i in range(150):
        parts = [text(rng.randint(0, 40))]
        if rng.random() < 0.5:
            parts += [rng.choice(items)[1] or "", text(rng.randint(0, 10))]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "..."), (7, docs[7][1]), (7, "other"), (None, docs[8][1]), (None, docs[8][1])]
    return docs, items


@pytest.mark.parametrize("narrow_limits", [False, True])
def test_report_equals_a_plain_search(spark, monkeypatch, narrow_limits):
    if narrow_limits:  # few slots, so most windows are looked up in vain, and joins by shuffle
        for name, value in {"MIN_SLOTS": 64, "MAX_SLOTS": 64, "BLOCK": 16, "MAX_BROADCAST_WINDOWS": 0}.items():
            monkeypatch.setattr(leaks, name, value)
    docs, items = corpus()
    got = leaks.report(*tables(spark, docs, items))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r[:-1] for r in plain(docs, items)), key=str)


def test_long_texts_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"{i % 977} x{i % 13}" for i in range(300_000)) + " " + passage + " end"
    docs, items = tables(spark, [(1, long), (2, passage * 2), (3, "clean")], [(9, passage)])
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in leaks.report(docs, items).collect()}
    # Glued to the next copy, the last word of the first one is another word.
    assert got == {1: (600_031, 30, True), 2: (59, 29 + 29, True), 3: (1, 0, False)}
    assert leaks.report(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in leaks.report(docs, items.limit(0)).collect()] == [False] * 3
    assert leaks.remove(docs, items.limit(0), ["doc_id", "text"]).count() == 3


def test_removal_of_spans_and_documents(spark):
    docs, items = corpus(8)
    frame, tests = tables(spark, docs, items)
    want = []
    for (key, text), (*_, hit) in zip(docs, plain(docs, items), strict=True):
        words = list(WORD.finditer(text or ""))
        cut, last = "", 0
        for i, m in enumerate(words):
            if i in hit:
                if i - 1 not in hit:
                    cut += text[last:m.start()]
                last = m.end()
        want.append((key, text if not hit else cut + text[last:]))
    got = leaks.remove(frame, tests, ["doc_id", "text"])
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = leaks.remove(frame, tests, ["doc_id", "hits", "text"], spans=False)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        (x for x, (*_, hit) in zip(docs, plain(docs, items), strict=True) if not hit), key=str)


def test_a_word_of_other_scripts_and_case(spark):
    docs, items = tables(spark, [(1, "ÉTÉ"), (2, "été"), (3, "Aİb"), (4, "aİB c")], [(1, "été"), (2, "aİb")])
    assert {r.doc_id: r.n_items for r in leaks.report(docs, items).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
