"""Names of a vocabulary in texts, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import ordered, vocabulary
from cairn.sources.shared import stored


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_matches(texts, names):
    known = {tuple(plain_words(n)) for n in names} - {()}
    longest = max(map(len, known), default=0)
    out = []
    for i, text in texts:
        w, at = plain_words(text), 0
        while at < len(w):
            n = next((n for n in range(min(longest, len(w) - at), 0, -1) if tuple(w[at : at + n]) in known), 0)
            if n:
                out.append((i, at, n, " ".join(w[at : at + n])))
            at += n or 1
    return sorted(out)


def found(spark, texts, names):
    got = vocabulary.find_names(spark.createDataFrame(texts, "id long, value string").withColumn("name", F.lit("x")), spark.createDataFrame([(n,) for n in names], "name string"))
    return sorted((r.id, r.at, r.n, r.name) for r in got.collect())


@pytest.mark.parametrize("few", [200_000, 3])
def test_leftmost_then_longest(spark, monkeypatch, few):
    monkeypatch.setattr(vocabulary, "FEW_PIECES", few)
    r = random.Random(4)
    pool = ["a", "b", "c", "d", "é", "7"]
    names = ["A", "b c", "C-b a", "c b a", "d " * 9, "a b c d a b c d", "é, 7", "b b b b b", "", "...", None] + [" ".join(r.choice(pool) for _ in range(r.randrange(2, 7))) for _ in range(60)]
    texts = [(k, r.choice([" ", ", ", "\n"]).join(r.choice(pool).upper() for _ in range(r.randrange(60)))) for k in range(120)]
    texts += [(900, None), (901, ""), (902, "d " * 4000), (903, "a_b_c"), (904, "Ab abc"), (905, "a b c d a b c d")]
    got = found(spark, texts, names)
    assert got == plain_matches(texts, names) and {n for _, _, n, _ in got} >= {1, 2, 3, 8, 9}
    assert sum(i == 902 for i, *_ in got) == 4000 // 9 + 0


def test_a_long_chain_of_overlaps(spark):
    texts = [(1, "x y " * 1500), (2, "y " + "x y " * 1500)]
    assert found(spark, texts, ["x y x", "y x"]) == plain_matches(texts, ["x y x", "y x"])


def test_nothing_to_find(spark):
    assert found(spark, [(1, "a b")], []) == [] == found(spark, [(1, "a b")], [None, "-"])
    assert found(spark, [], ["a"]) == []


def test_new_entities_and_edges_once(spark):
    texts = spark.createDataFrame([(1, "Red ring and red ring"), (2, "the RED  ring, a blue bolt"), (3, None)], "id long, value string")
    names = spark.createDataFrame([("red ring",), ("Red Ring",), ("blue-bolt",), ("hot gear",)], "name string")
    new, edges = vocabulary.link_names(texts, names, spark.createDataFrame([("Blue Bolt",)], "name string"))
    assert [r.name for r in new.collect()] == ["red ring"]
    assert sorted((r.fact_id, r.name) for r in edges.collect()) == [(1, "red ring"), (2, "blue bolt"), (2, "red ring")]


def test_only_pieces_of_names_are_broadcast(spark, monkeypatch):
    """Tables that grow with the texts are joined by shuffles: a broadcast goes through the driver."""
    plans = []

    def seen(df, label, *a):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, label, *a)

    monkeypatch.setattr(vocabulary, "stored", seen)
    monkeypatch.setattr(ordered, "stored", seen)
    texts = spark.createDataFrame([(k, "red fox red fox jumps") for k in range(30)], "id long, value string")
    names = spark.createDataFrame([("red fox",), ("fox red fox",), ("jumps",)], "name string")
    found = vocabulary.find_names(texts, names)
    assert sorted((r.at, r.name) for r in found.where("id = 7").collect()) == [(0, "red fox"), (2, "red fox"), (4, "jumps")]
    plans.append(("last", found._jdf.queryExecution().executedPlan().toString()))
    assert {label for label, plan in plans if "BroadcastExchange" in plan} <= {"matches"}  # which is made with the pieces
    assert {"reached", "last"} <= {label for label, _ in plans}
