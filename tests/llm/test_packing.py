"""Tokens against the library, curve keys against their defining property, and packing as an exact round trip."""

import random
import zlib

import numpy as np
import pytest

from seekspark.llm import packing, tokens
from seekspark.llm.hilbert import hilbert_keys
from seekspark.llm.packing import PackingConfig


@pytest.fixture(scope="module")
def maker():
    return tokens.WordTokenizer(tokens.tokenizer_text())


def library(maker, text):
    return maker.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(maker):
    rng = random.Random(5)
    bits = ["Hello", "don't", "'s", "'", "it's", " ", "\n", "\t", "\x1c", "\x85", " ", " ", "é", "é", "́", "É.", "Σας.", "ΣΑΣ", "İ", "ß", "12", "٣", "²", "Ⅷ",
            "<|endoftext|>", "<|", "|>", "...", "a.b,c!", "中文", "🙂", "‍", "ﬁ", "x" * 70, "\x00", "\x7f", "naïve", "Ǆ", "ʼn", "$5", "_", "-", "ŉ", "K", "각", "가"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(maker.ids([text])[0], maker.type).tolist() == library(maker, text), repr(text)


def test_ids_of_latin_texts_equal_the_library(maker):
    rng = random.Random(12)
    for _ in range(4000):
        text = "".join(chr(rng.randint(0, 255)) if rng.random() < 0.6 else rng.choice("abcST'  .") for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(maker.ids([text])[0], maker.type).tolist() == library(maker, text), repr(text)


def test_forgetting_changes_nothing(maker, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    texts = [f"word{i} and some{i % 7} more words" for i in range(50)]
    for text in texts * 2:
        assert np.frombuffer(maker.ids([text])[0], maker.type).tolist() == library(maker, text)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (1, 6)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_powers_of_two():
    for n in range(0, 600):
        got = packing.powers_of_two(n)
        assert sum(got) == n and all(x & (x - 1) == 0 for x in got)


def check(pieces, texts, maker, length):
    """texts: (doc_id, text) rows; repeated ids must carry the same text."""
    ids = {k: [*library(maker, t or ""), 2] for k, t in texts}
    by_copy = {}
    for p in pieces:
        by_copy.setdefault((p.doc_id, p.copy), []).append(p)
        want = ids[p.doc_id][p.start:p.start + p.length]
        assert len(want) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert len(by_copy) == len(texts)
    for (key, _), own in by_copy.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own[:-1]]).tolist() and sum(p.length for p in own) == len(ids[key])
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own[:-1]]).tolist()
        size = sum(p.length for p in own)
        assert size <= length and (size == length or size & (size - 1) == 0)


def test_packing_is_a_round_trip(spark, maker):
    rng = random.Random(9)
    words = ["alpha", "beta", "Gamma", "delta.", "épsilon", "42"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 900])))) for i in range(120)]
    texts += [(500, None), (501, ""), (502, "hot copy of some words"), (502, "hot copy of some words"), (502, "hot copy of some words"), (None, "no id")]
    texts += [(600 + i, "the same text many times") for i in range(80)]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in texts], "doc_id long, text string, copy int, ids string").repartition(3)
    check(packing.pack(frame, PackingConfig(length=64, task_tokens=3000)).collect(), texts, maker, 64)
    check(packing.pack(frame).collect(), texts, maker, 4096)
    assert packing.pack(frame.limit(0)).count() == 0


def test_sequences_hold_their_ids(spark, maker):
    texts = [(i, f"document number {i} says " + "word " * i) for i in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packing.sequences(frame, PackingConfig(length=128)).collect()
    held = b"".join(p.ids for r in rows for p in r.pieces)
    assert len(held) == 2 * sum(len(library(maker, t)) + 1 for _, t in texts)
