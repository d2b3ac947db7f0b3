"""Near-duplicates by shingle similarity against brute force, and their recall by similarity."""

import random

import numpy as np
import pytest

from seekspark.llm import similar, simhash
from seekspark.llm.simhash import part_values
from seekspark.llm.similar import SimilarConfig


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def likeness(x, y):
    both = len(x & y)
    return both / max(1, len(x) + len(y) - both)


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def pairs(spark):
    """(similarity, linked) of generated pairs of 300 words, all in one table."""
    rng = random.Random(5)
    rows, want = [], []
    for i in range(600):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        other = edited(rng, words, 1 + i % 9)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, other)]
        want.append(likeness(plain_set(" ".join(words)), plain_set(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table, rooted, named = similar.classes(docs, "doc_id", "text")
    got = {r.key: r.component_id for r in table.join(rooted, "fp").join(named, "root").collect()}
    assert len(got) == 1200 and all(c // 2 == k // 2 for k, c in got.items())
    return [(s, got[2 * i + 1] == 2 * i) for i, s in enumerate(want)]


def test_recall_at_the_least_similarity_and_no_link_below(pairs):
    assert not any(linked for s, linked in pairs if s < 0.8)
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.95), (0.9, 0.95, 0.97), (0.95, 1.01, 0.99)):
        found = [linked for s, linked in pairs if low <= s < high]
        assert len(found) > 50 and np.mean(found) >= least, (low, np.mean(found))


def test_codes_are_majorities_of_the_different_shingles():
    sets = [similar.shingle_set(t, 5) for t in ("a b c d e f g", None, " ".join(f"w{i}" for i in range(70_000)), "one two")]
    made = similar.codes_of(sets, 2)
    for row, hashes in zip(made, sets, strict=True):
        for w in range(2):
            h = simhash._mix(hashes + np.array([similar._STEP]) * np.uint64(w + 1))
            want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
            assert int(row[w]) == want
    assert [len(s) for s in sets] == [3, 0, 69_996, 1]


def test_thresholds_reach_the_wanted_recall_and_shun_hot_values():
    config = SimilarConfig()
    rng = np.random.default_rng(1)
    code = rng.integers(0, 2**63, (4000, config.words), dtype=np.uint64)
    code[:3000, 0] = 7  # four parts whose value three quarters of the texts share
    parts = [(w, bits) for w in range(config.words) for bits in simhash.grouped_bits(np.zeros((64, 64)), 0, 4)]
    counts = np.stack([np.bincount(part_values(code[:, w], [bits])[:, 0] & 4095, minlength=4096) for w, bits in parts])
    aimed = similar.Aimed(parts, counts, config)
    chosen = aimed.thresholds(aimed.values(code))
    gains = np.array(aimed.gains)[chosen + 1].sum(axis=1)
    assert gains.min() >= aimed.goal
    assert (chosen[:3000, :4] == -1).mean() > 0.9 and (chosen[3000:, :4] >= 0).mean() > 0.5


@pytest.mark.parametrize("block", [8192, 16])
def test_hot_groups_and_odd_rows(spark, block):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, 1)) for i in range(80)]  # all near each other
    rows += [(1000 + i, " ".join(f"x{rng.random()}" for _ in range(50))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE  two"), (2005, "one three"), (None, "one two"), (2003, "one two")]
    rows += [(2006, " ".join(f"y{i}" for i in range(200_000))), (2007, " ".join(f"y{i}" for i in range(200_000)) + " z")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string").repartition(3)
    kept = simhash.one_of_each(docs, ["doc_id", "text"], SimilarConfig(block=block), False, similar.classes)
    got = sorted(r.doc_id for r in kept.collect())
    assert got == [0, *range(1000, 1060), 2000, 2003, 2005, 2006]
    assert similar.classes(docs.limit(0), "doc_id", "text")[0].count() == 0
    assert simhash.one_of_each(docs.limit(0), ["doc_id", "text"], SimilarConfig(), False, similar.classes).count() == 0
