"""Components after further edges, and how many times the whole graph is followed for them."""

from seekspark.llm import graph, similar


def groups(roots):
    found = {}
    for node, root in roots.collect():
        found.setdefault(root, set()).add(node)
    assert all(root in nodes for root, nodes in found.items())
    return sorted(sorted(nodes) for nodes in found.values())


def test_further_edges_join_components(spark):
    first = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (8, 9), (20, 21)], "a long, b long")
    more = spark.createDataFrame([(3, 6), (7, 5), (10, 11), (8, 9), (11, 12)], "a long, b long")
    roots = graph.joined(graph.components(first), more)
    assert groups(roots) == groups(graph.components(first.union(more))) == [[1, 2, 3, 5, 6, 7], [8, 9], [10, 11, 12], [20, 21]]
    assert groups(graph.joined(graph.components(first), more.limit(0))) == groups(graph.components(first))


def test_links_are_followed_once(spark, monkeypatch):
    followed = []
    monkeypatch.setattr(similar, "components", lambda edges: followed.append(1) or graph.components(edges))
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(n, " ".join([*words[n:], *words[:n]])) for n in range(3)], "doc_id long, text string")
    _, _, named = similar.classes(docs, "doc_id", "text")
    assert [r.component_id for r in named.collect()] == [0] and len(followed) == 1
