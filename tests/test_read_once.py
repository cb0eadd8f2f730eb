"""Costly columns over whole texts are made once a row, however many branches of a plan need them."""

import pytest

from cairn import plans
from cairn.functions import text
from cairn.operators import graph, writes
from cairn.plans.filters import TIER_WORDS
from cairn.sources.tables import AS_OF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_linking_reads_facts_once(spark, folder):
    assert "regexp_extract_all" not in plan(plans.QUERIES["e6_link_entities"](spark, folder))


@pytest.mark.parametrize("names", [text.mentions, text.entities])
def test_linking_names_that_repeat(spark, names):
    facts = spark.createDataFrame([(3, "'Bo' and 'ann' and 'Ann' and 'BO'"), (1, "'ANN' 'x' 'X' 'ann'"), (2, ""), (4, None), (5, "'bo' or 'Bo'")], "id long, fact_value string")
    known = spark.createDataFrame([("aNN",), (None,)], "name string")
    new, edges = graph.link_entities(facts, known, names)
    assert sorted(r.name for r in new.collect()) == ["Bo", "x"]
    assert sorted((r.fact_id, r.name) for r in edges.collect()) == [(1, "ANN"), (1, "x"), (3, "ANN"), (3, "Bo"), (5, "Bo")]


def test_entities_bind_their_names(spark):
    """Names are found once a text, not anew for each of its names: the pattern stands in the column once."""
    assert text.entities(spark.range(1).selectExpr("'a' AS t").t, [r"\bAI\b"])._jc.toString().count("AI") == 1


def test_guarded_facts_are_guarded_once(spark):
    new = spark.createDataFrame([(1, "a", "c", "k", "plain words of a fact", None)], "id long, agent_id string, category string, fact_key string, fact_value string, memory_tier string")
    old = spark.createDataFrame([(2, "a", "c", "plain words of a fact.")], "id long, agent_id string, category string, fact_value string")
    done = writes.write_facts(new, old, AS_OF, TIER_WORDS)
    assert "array_sort" not in plan(done)  # of the guard's lines
    assert [(r.id, r.action, r.fact_id) for r in done.collect()] == [(1, "merge", 2)]
