"""Collision rates against the exact similarity, and the neighbour query against a plain loop."""

import hashlib
import random
from collections import Counter

import numpy as np

from seekspark.llm import fingerprint as fp
from seekspark.llm.fingerprint import FingerprintConfig


def exact(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(4)
    config = FingerprintConfig(samples=4096)
    for heavy in (1, 3, 12):
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            a = Counter({f"w{i}": rng.randint(1, heavy) for i in range(60)})
            b = Counter({(k if rng.random() < share else k + "x"): max(1, v + (rng.random() > share) * rng.randint(-2, 2)) for k, v in a.items()})
            made = fp.signatures([a, b], config)
            assert abs(fp.likeness(made[:1], made[1:])[0] - exact(a, b)) < 0.035


def test_samples_do_not_depend_on_the_batch():
    rng = random.Random(8)
    bags = [Counter(f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 900))) for _ in range(60)]
    together = fp.signatures(bags)
    assert all((fp.signatures([b])[0] == t).all() for b, t in zip(bags, together, strict=True))


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 3
        out[key] = (len(text), hashlib.sha256((text[:len(text) - n] + following[:n]).encode()).hexdigest(), following)
    return out


def test_neighbours(spark):
    rng = random.Random(2)
    words = "alpha beta gamma délta 中文字 🙂 eps".split()
    rows = [(i * 7 % 501, " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(rng.choice([0, 1, 3, 30, 200])))) for i in range(150)]
    rows += [(600, None), (601, "x" * 5000), (602, rows[0][1]), (603, rows[0][1]), (None, "without an id")]
    frame = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, fingerprint string, role int").repartition(5)
    got = {r.doc_id: r for r in fp.with_neighbours(frame).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for key, (n, sha, following) in want.items():
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        made = fp.signatures([fp.terms_of(following)])[0]
        own = np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8)
        assert r.near_next == fp.likeness(own[None], made[None])[0]
    assert got[602].fingerprint == got[603].fingerprint and got[603].near_next == 1.0
    alone = fp.with_neighbours(frame.filter("doc_id = 601")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fp.with_neighbours(frame.limit(0)).count() == 0


def test_likeness_in_sql_equals_the_estimate(spark):
    bags = [Counter(str(i % m) for i in range(200)) for m in (50, 60, 70)]
    made = fp.signatures(bags)
    frame = spark.createDataFrame([(a.tobytes().hex(), b.tobytes().hex(), float(fp.likeness(a[None], b[None])[0])) for a in made for b in made], "a string, b string, v double")
    from pyspark.sql import functions as F

    assert all(abs(r.v - r.w) < 1e-12 for r in frame.withColumn("w", fp.likeness_column(F.col("a"), F.col("b"))).collect())
