"""Counts after edits against encoding the edited text as a whole."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seekspark.llm import counts


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return counts.PieceCounter(file.read(), public_tokenizers.PATTERN)


BITS = ["word", " ", "  ", "\n", "\n\n ", "'", "'s", "'ll", "l", "don't", "12", "é", "́", "中文", "🙂", "!?", ".", "<|endoftext|>", " x", "\t", "Ünï", "A" * 70, "\x85"]


def text_of(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_edited_trees_equal_new_ones(counter, library):
    rng = random.Random(6)
    for turn in range(600):
        text = text_of(rng, rng.choice([0, 1, 5, 40, 400, 3000]) if turn % 20 == 0 else rng.choice([0, 1, 5, 40]))
        tree = counts.TokenTree(counter, counter.divide(text))
        assert tree.tokens == library(text)
        for _ in range(6):
            start, length = rng.randint(0, len(text) + 1), rng.choice([0, 0, 1, 2, 5, 40, 500])
            new = text_of(rng, rng.choice([0, 1, 2, 8, 200 if turn % 20 == 0 else 3]))
            tree.edit(start, length, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + length:]
            assert "".join(tree.walk(0)) == text and list(tree.walk(0)) == counter.divide(text)
            assert (tree.root.chars, tree.root.size, tree.tokens) == (len(text), len(counter.divide(text)), library(text))


def test_an_edit_encodes_only_its_region(counter):
    text = "The quick brown fox jumps over the lazy dog. " * 20_000
    tree = counts.TokenTree(counter, counter.divide(text))
    tree.edit(450_000, 3, "slow")
    assert 0 < tree.encoded < 60
    tree.edit(0, 0, "x")
    tree.edit(tree.root.chars, 0, " end")
    assert tree.encoded < 150


def test_rows(spark, library):
    rng = random.Random(1)
    rows = [(i, text_of(rng, rng.choice([0, 3, 60])), "x") for i in range(60)] + [(3, "again", None), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, counts string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in counts.count_edits(frame, counts.sample_edits()).collect())
    want = []
    for key, text, _ in rows:
        text = text or ""
        n, now = len(text), text
        for start, length, new in ((n // 4, 20, ""), (n // 2, 0, text[:40]), (n * 3 // 4, 10, None)):
            if new is None:
                new = spark.createDataFrame([(text,)], "t string").select(F.upper(F.substring("t", 5, 12))).first()[0]
            start = min(start, len(now))
            now = now[:start] + new + now[start + length:]
        want.append((key if key is not None else -1, library(text), library(now), len(now)))
    assert got == sorted(want)
    bare = frame.drop("counts").filter("doc_id <> 3")
    both = counts.count_edits(bare.join(counts.trees(bare), "doc_id"), counts.sample_edits(), kept=True)
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in both.collect()) == sorted(x[:3] for x in want if x[0] not in (-1, 3))
    odd = frame.limit(1).withColumn("e", F.expr("array(null, named_struct('start', -5, 'length', 999999, 'replacement', cast(null as string)))"))
    assert counts.count_edits(odd, F.col("e")).first().n_tokens_edited == 0
    assert counts.count_edits(frame.limit(0), counts.sample_edits()).count() == 0
