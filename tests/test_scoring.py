import re

import pytest
from pyspark.sql import functions as F

from seekspark.config import EngineConfig
from seekspark.functions import confidence, intent, scoring, text

def Q():
    return F.col("q")


def test_intent(evaluate):
    cases = {
        "where is the User class defined?": "User", "Where are `foo_bar` defined": "foo_bar", "definition of Foo": "Foo",
        "definitions of the Bar module": "Bar", "find the Baz definition": "Baz", "show definition": "show", "define `x1`": "x1",
        "define": None, "where is it": None, "def": None, "definition of `Foo`": "Foo",
    }
    assert evaluate([(q,) for q in cases], "q string", intent.definition_intent(Q())) == list(cases.values())


def test_inferred_target(evaluate):
    cases = {
        "UserService": "UserService", "`UserService`": "UserService", "user_service": "user_service", "find UserService": "UserService",
        "find user": None, "locate my_func!": "my_func", "find user service base class": "UserService", "go to The Thing": "Thing",
        "navigate to Thing": "Thing", "Usr": None, "a b": None, "find the A1 b! base class": None, "x" * 129: None,
    }
    assert evaluate([(q,) for q in cases], "q string", intent.inferred_target(Q())) == list(cases.values())


def test_shares_against_a_loop(evaluate):
    queries = ["getUser in lib/user_api.rb now.", "a", "foo.bar foo.bar x-y $el", "über straße ok"]
    bodies = ["the getuser foo.bar, x-y lib/user_api.rb now.", "xfoo.bar foo.barx $el$ getuserx", "", "ber stra ok_"]
    rows = [(q, b) for q in queries for b in bodies]
    tokens = text.query_tokens(Q())
    got = evaluate(rows, "q string, b string", F.struct(
        text.share_contained(tokens, F.col("b")), text.share_whole_words(tokens, text.word_patterns(tokens), F.col("b")),
    ))
    for (q, b), found in zip(rows, got):
        want = [t.lower() for t in re.findall(r"[A-Za-z0-9_.$/-]+", q) if len(t) >= 2]
        share = lambda test: sum(map(test, want)) / len(want) if want else 0  # noqa: B023, E731
        assert found[0] == pytest.approx(share(lambda t: t in b))
        assert found[1] == pytest.approx(share(lambda t: bool(re.search(rf"(^|[^a-z0-9_]){re.escape(t)}([^a-z0-9_]|\Z)", b))))


def test_word_lists_use_ascii_boundaries(evaluate):
    rows = [("étest",), ("a spec.",), ("respect",), ("client side",), ("React",)]
    assert evaluate(rows, "q string", text.mentions_tests(Q())) == [True, True, False, False, False]
    assert evaluate(rows, "q string", text.mentions_frontend(Q())) == [False, False, False, True, True]


def test_sigmoid_does_not_overflow(evaluate):
    assert evaluate([(0.0,), (1000.0,), (-1000.0,)], "q double", scoring.sigmoid(Q())) == [0.5, 1.0, 0.0]


CASES = [
    ([], [], "x y z", "low", ["no_hits"]),
    ([0.2], ["a.rb"], "x y z", "low", ["low_primary_score"]),
    ([0.2, 0.199], ["a.rb", "b.rb"], "x y z", "low", ["tight_top_scores", "low_primary_score"]),
    ([0.9], ["a.rb"], "x y z", "high", ["strong_top_and_separation"]),
    ([0.9, 0.5], ["a.rb", "b.ts"], "x y z", "medium", ["top_hits_different_path_families", "strong_top_and_separation"]),
    ([0.9, 0.5], ["a.rb", "b.md"], "the thing", "medium", ["possible_ambiguous_literal_query", "strong_top_and_separation"]),
    ([0.9, 0.89], ["a.rb", "b.rb"], "x y z", "medium", ["strong_score_but_tight_top", "tight_top_scores"]),
    ([0.4, 0.399], ["a.rb", "b.rb"], "x y z", "medium", ["tight_top_scores"]),
    ([0.4, 0.1], ["a.rb", "b.rb"], "x y z", "medium", ["below_strong_threshold"]),
    ([0.5, 0.9], ["a.rb", "b.rb"], "x y z", "medium", ["tight_top_scores"]),
]


def test_confidence_table(spark):
    queries = spark.createDataFrame([(i, c[2]) for i, c in enumerate(CASES)], "query_id bigint, query string")
    rows = [(i, n + 1, p, 0.0, s) for i, c in enumerate(CASES) for n, (s, p) in enumerate(zip(c[0], c[1]))]
    hits = spark.createDataFrame(rows, "query_id bigint, ord int, path string, score double, rerank_score double")
    got = {r.query_id: r for r in confidence.assess(queries, hits, EngineConfig()).collect()}
    for i, (scores, _, _, level, reasons) in enumerate(CASES):
        assert (got[i].match_confidence, got[i].match_confidence_reasons) == (level, reasons), CASES[i]
        assert (got[i].top_relative_separation is None) == (len(scores) < 2)
        assert got[i].match_confidence_hint
