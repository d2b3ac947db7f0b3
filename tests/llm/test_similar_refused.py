"""Large groups of near codes in which edges of the forests are refused."""

import random

from seekspark.llm import similar
from seekspark.llm.similar import SimilarConfig

from tests.llm.test_similar import edited, likeness, plain_set


def roots_of(names, linked):
    root = {n: n for n in names}
    for x, y in linked:
        low, high = sorted((root[x], root[y]))
        root = {n: low if r == high else r for n, r in root.items()}
    return root


def test_refused_edges_lose_no_other_links(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = {i: edited(rng, base, 2 + i % 3) for i in range(60)}
    sets = {i: plain_set(t) for i, t in texts.items()}
    want = roots_of(texts, [(i, j) for i in texts for j in texts if i < j and likeness(sets[i], sets[j]) >= 0.8])
    # The codes are near for all of them; a forest alone would try 59 pairs.
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    table, rooted, named = similar.classes(docs, "doc_id", "text", SimilarConfig())
    got = {r.key: r.component_id for r in table.join(rooted, "fp").join(named, "root").collect()}
    assert 1 < len(set(want.values())) < 40
    assert got == want
