"""Fingerprints, links and components against brute force."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from seekspark.llm import simhash
from seekspark.llm.graph import components
from seekspark.llm.simhash import SimhashConfig


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_roots(fps, radius=4):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(rng, n=1500):
    """Random fingerprints, chains of small changes, a dense cluster, and many that share half of their bits."""
    out = list(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    hot = rng.integers(0, 2**32, n, dtype=np.uint64)
    out += list(hot << np.uint64(32))
    centre = np.uint64(0x0123456789ABCDEF)
    for k in range(n // 3):
        flips = rng.choice(64, rng.integers(0, 7), replace=False)
        out.append(centre ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0)))
    at = rng.integers(0, 2**63, dtype=np.uint64)
    for _ in range(60):
        out.append(at)
        at ^= np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("config", [SimhashConfig(), SimhashConfig(block=64), SimhashConfig(parts=3), SimhashConfig(parts=2), SimhashConfig(parts=5)])
def test_links_connect_what_brute_force_connects(spark, config):
    fps = clustered(np.random.default_rng(7))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    edges = simhash.links(frame, config)
    pairs = np.array([(r.a, r.b) for r in edges.collect()], np.int64).view(np.uint64)
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 4).all()
    roots = {r.node: r.root for r in components(edges).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = plain_roots(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_thresholds_obey_the_principle():
    fps = clustered(np.random.default_rng(3))
    parts = simhash.grouped_bits(np.zeros((64, 64)), 0, 4)
    assert sorted(np.concatenate(parts)) == list(range(64))
    values = simhash.part_values(fps, parts)
    counts = np.stack([np.bincount(values[:, p], minlength=1 << 16) for p in range(4)])
    chosen = simhash.Allocation(parts, counts, 4).thresholds(values)
    assert (chosen.sum(axis=1) == 1).all() and chosen.min() >= -1


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    texts = ["The quick brown fox jumps over the lazy dog", "the QUICK brown fox jumps over the lazy dog", "", None, " \t ", "one two", "ÄRGER one two three four",
             "ärger one two three four", long, long, "one two three"]
    rows = [(100 - i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(None, "", "x", 0.0), (100, texts[0], None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, key double")
    out = simhash.near_duplicates(frame).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out}
    for i, t in enumerate(texts):
        assert got[100 - i][0] == format(plain_fingerprint(t), "016x")
    assert got[100][1] == got[99][1] == 99 and got[98][1] == got[97][1] == got[96][1] == got[None][1] == 96
    assert got[92][1] == got[91][1] == 91
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    kept = Counter(r.doc_id for r in simhash.one_of_each(frame, ["doc_id", "text"]).collect())
    assert kept[99] == 1 and 100 not in kept and kept[96] == 1 and kept[None] == 1


def test_texts_of_any_length_are_hashed_in_bounded_memory():
    config = simhash.SimhashConfig()
    long = " ".join(f"w{i % 7919}" for i in range(2_000_000))
    tracemalloc.start()
    made = simhash.fingerprints_of(["a b c d e", long, None], config)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # the bits of all shingles at once would take as much again, in bytes
    hashes = np.concatenate(list(simhash.shingle_hashes(long, config.shingle, config.seed)))
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert int(made[1]) == want and made[2] == 0
