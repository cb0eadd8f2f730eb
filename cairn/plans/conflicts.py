"""Queries of texts that end facts, and of the states of replaced memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts
from ..sources.tables import relation, table
from .registry import query
from .rest import SQL_EVOLUTION, e16_evolution_edges

#: From any table of edges (old_id, new_id): walks along the greatest replacement, to its end or round a circle.
SQL_CHAINS = """SELECT memory_id, CASE WHEN memory_id = successor THEN 'active' ELSE 'superseded' END AS state, successor FROM (
 WITH RECURSIVE hop AS (SELECT old_id AS id, max(new_id) AS nxt FROM edges WHERE old_id <> new_id GROUP BY old_id), w AS (
 SELECT id, id AS here, [id] AS path, false AS round FROM (SELECT old_id AS id FROM edges UNION SELECT new_id FROM edges) n UNION ALL
 SELECT w.id, nxt, list_append(path, nxt), list_contains(path, nxt) FROM w JOIN hop ON hop.id = w.here WHERE NOT w.round)
 SELECT id AS memory_id, CASE WHEN arg_max(round, len(path)) THEN list_max(list_slice(arg_max(path, len(path)), list_position(arg_max(path, len(path)), arg_max(here, len(path))), -1)) ELSE arg_max(here, len(path)) END AS successor FROM w GROUP BY id) c"""
SQL_STATES = f"WITH edges AS (SELECT old_id, new_id FROM ({SQL_EVOLUTION}) e WHERE relation = 'replaces') {SQL_CHAINS}"


def evolution_states(spark: SparkSession, folder: str) -> DataFrame:
    return conflicts.live_successors(e16_evolution_edges(spark, folder).where("relation = 'replaces'"))


@query(SQL_STATES)
def e16_states(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each memory that replaces one or is replaced, and what stands for it now."""
    return evolution_states(spark, folder)


@query(f"WITH edges AS (SELECT p_partkey AS old_id, CASE WHEN p_partkey % 9 = 0 THEN p_partkey - p_partkey % 90 ELSE p_partkey + 1 + p_partkey % 7 END AS new_id FROM part) {SQL_CHAINS}")
def e16_long_chains(spark: SparkSession, folder: str) -> DataFrame:
    """As e16_states, of replacements of all parts by later ones, some of which lead back."""
    k = F.col("p_partkey")
    edges = table(spark, folder, "part").select(k.alias("old_id"), F.when(k % 9 == 0, k - k % 90).otherwise(k + 1 + k % 7).alias("new_id"))
    return conflicts.live_successors(edges)


#: A rule for each passage: who says its fifth long word ends what says its second. Words of five letters or more, in ASCII.
SQL_RULES = "SELECT item_id AS rule, w[2] AS o, w[5] AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{5,}') AS w FROM benchmark) b WHERE len(w) >= 5"


@query(
    f"""WITH r AS ({SQL_RULES}), told AS (SELECT rule, profile, id, recorded_s FROM facts JOIN r ON regexp_matches(fact_value, '(?i)' || n || '[ ,.]')),
 olds AS (SELECT rule, profile, id, recorded_s, valid_to_s FROM facts JOIN r ON regexp_matches(fact_value, '(?i)' || o || '[ ,.]')),
 met AS (SELECT o.id, o.rule, o.valid_to_s, min((n.recorded_s, n.id)) AS x FROM olds o JOIN told n ON n.rule = o.rule AND n.profile = o.profile AND (n.recorded_s, n.id) > (o.recorded_s, o.id) GROUP BY o.id, o.rule, o.valid_to_s),
 first AS (SELECT id, min((x, rule)) AS y FROM met WHERE valid_to_s IS NULL OR valid_to_s > x[1] GROUP BY id)
 SELECT id AS fact_id, y[1][1] AS closed_s, y[1][2] AS by_id, y[2] AS rule FROM first""",
    "facts",
)
def g23_text_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What each fact's text ends among older facts of its profile, by a rule for each benchmark passage."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    pair = table(spark, folder, "benchmark").select(F.col("item_id").alias("rule"), w.alias("w")).where("size(w) >= 5")
    side = lambda name, word: pair.select("rule", F.lit(name).alias("side"), F.concat(word, F.lit("[ ,.]")).alias("pattern"), F.array(word).alias("literals"))
    rules = side("old", F.get("w", F.lit(1))).unionByName(side("new", F.get("w", F.lit(4))))
    facts = relation(spark, folder, "facts").select("id", F.col("profile").alias("tenant"), F.col("recorded_s").alias("at_s"), F.col("fact_value").alias("value"), "valid_to_s")
    return conflicts.resolve_conflicts(facts, facts, rules)
