"""Duplicate checks, upserts, votes and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import writes
from ..sources.tables import relation, table
from .registry import query
from .textual import SQL_JACCARD, sql_grams

LANES = "CASE WHEN id % 3 = 0 THEN 'rejected' WHEN id % 5 = 0 THEN 'committed' ELSE 'pending' END"


@query(
    f"""WITH g AS (SELECT id, coalesce(agent_id, 'local') AS agent_id, category, {sql_grams('fact_value', 2)} AS a FROM facts WHERE archived = 0),
 best AS (SELECT n.id, {SQL_JACCARD.format('n.a', 'o.a')} AS s, o.id AS m FROM g n JOIN g o ON n.agent_id = o.agent_id AND n.category = o.category AND n.id <> o.id),
 top AS (SELECT id, max(s) AS s, arg_max(m, (s, -m)) AS m FROM best WHERE s >= 0.7E0 GROUP BY id)
 SELECT g.id, round(coalesce(s, 0), 6) AS similarity, coalesce(m, -1) AS match_id, CASE WHEN coalesce(s, 0) >= 0.85E0 THEN 'merge' WHEN coalesce(s, 0) >= 0.7E0 THEN 'update' ELSE 'insert' END AS action
 FROM g LEFT JOIN top USING (id)""",
    "facts",
)
def f1_check_duplicate(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact against all others of its agent and category."""
    facts = relation(spark, folder, "facts").where("archived = 0").withColumn("agent_id", F.coalesce("agent_id", F.lit("local")))
    return writes.check_duplicate(facts, facts).select("id", F.round("similarity", 6).alias("similarity"), F.coalesce("match_id", F.lit(-1)).alias("match_id"), "action")


@query(
    """WITH o AS (SELECT id AS fact_key, trust_score, valid_to_s FROM facts WHERE id % 3 <> 0), n AS (SELECT id AS fact_key, trust_score / 2 AS trust_score, CASE WHEN id % 2 = 0 THEN recorded_s END AS valid_to_s FROM facts WHERE id % 4 <> 0)
 SELECT fact_key, CASE WHEN n.trust_score IS NOT NULL THEN n.trust_score ELSE o.trust_score END AS trust_score, coalesce(n.valid_to_s, o.valid_to_s, -1) AS valid_to_s,
 CASE WHEN n.trust_score IS NOT NULL AND o.trust_score IS NOT NULL THEN 'updated' WHEN n.trust_score IS NOT NULL THEN 'inserted' ELSE 'kept' END AS change FROM o FULL JOIN n USING (fact_key)""",
    "facts",
)
def f4_upsert(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").withColumn("fact_key", F.col("id"))
    old = facts.where("id % 3 <> 0").select("fact_key", "trust_score", "valid_to_s")
    new = facts.where("id % 4 <> 0").select("fact_key", (F.col("trust_score") / 2).alias("trust_score"), F.expr("CASE WHEN id % 2 = 0 THEN recorded_s END").alias("valid_to_s"))
    merged = writes.upsert(old, new, ["fact_key"], [F.desc("trust_score")], keep_old=["valid_to_s"])
    return merged.withColumn("valid_to_s", F.coalesce("valid_to_s", F.lit(-1)))


@query(
    "SELECT user_id, session_id, sha256(trim(content)) AS content_hash, min(turn) AS first_turn, count(*) AS occurrences, min(ts_s) AS first_s, max(ts_s) AS last_s FROM turns WHERE trim(content) <> '' GROUP BY user_id, session_id, sha256(trim(content))",
    "turns",
)
def f5_store_turns(spark: SparkSession, folder: str) -> DataFrame:
    return writes.store_turns(relation(spark, folder, "turns"))


@query(
    """WITH n AS (SELECT l_partkey AS fact_id, l_suppkey AS source, l_orderkey * 10 + l_linenumber AS seq, CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN 'oppose' ELSE 'neutral' END AS stance, l_discount * 20 AS confidence FROM lineitem),
 l AS (SELECT fact_id, source, arg_max(stance, seq) AS stance, arg_max(confidence, seq) AS confidence FROM n GROUP BY fact_id, source)
 SELECT fact_id, source, stance, round(least(greatest(confidence, 0E0), 1E0), 6) AS confidence FROM l UNION ALL SELECT -1, 7, 'support', 0.5E0"""
)
def f12_opinions(spark: SparkSession, folder: str) -> DataFrame:
    """The last opinion of each source on each fact, confidence clamped; an old one that none replaces stays."""
    stance = F.when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "R", "oppose").otherwise("neutral")
    new = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("fact_id"), F.col("l_suppkey").alias("source"), stance.alias("stance"), F.least(F.greatest(F.col("l_discount") * 20, F.lit(0.0)), F.lit(1.0)).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    old = spark.sql("SELECT -1L AS fact_id, 7L AS source, 'support' AS stance, 0.5D AS confidence")
    return writes.upsert(old, new, ["fact_id", "source"], [F.desc("seq")]).select("fact_id", "source", "stance", F.round("confidence", 6).alias("confidence"))


@query(
    """WITH c AS (SELECT fact_id, stance, least(greatest(confidence, 0E0), 1E0) AS confidence FROM opinions), p AS (SELECT fact_id, stance, count(*) AS n, avg(confidence) AS mean FROM c GROUP BY fact_id, stance),
 t AS (SELECT fact_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS votes FROM p GROUP BY fact_id HAVING sum(n) >= 2), w AS (SELECT t.fact_id, votes, count(*) AS winners, min(stance) AS stance, min(mean) AS mean FROM t JOIN p ON p.fact_id = t.fact_id AND p.n = t.most GROUP BY t.fact_id, votes)
 SELECT w.fact_id, CASE WHEN winners = 1 THEN w.stance ELSE 'neutral' END AS stance, round(CASE WHEN winners = 1 THEN w.mean ELSE coalesce(p.mean, 0.5E0) END + 1E-9, 4) AS confidence, votes
 FROM w LEFT JOIN p ON p.fact_id = w.fact_id AND p.stance = 'neutral'""",
    "opinions",
)
def h12_opinion_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    found = writes.aggregate_opinions(relation(spark, folder, "opinions"))
    return found.withColumn("confidence", F.round(F.col("confidence") + 1e-9, 4))


@query(
    f"""SELECT id AS candidate_id, category, CASE WHEN s <> 'pending' OR id % 7 = 0 THEN s WHEN id % 2 = 0 THEN 'rejected' WHEN trust_score >= 0.9E0 AND category IN ('src1', 'src2') THEN 'committed' ELSE 'evaluated' END AS status
 FROM (SELECT *, {LANES} AS s FROM facts) t""",
    "facts",
)
def f9_review(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts")
    candidates = facts.select(F.col("id").alias("candidate_id"), "category", F.expr(LANES).alias("status"))
    verdicts = facts.where("id % 7 <> 0").select(F.col("id").alias("candidate_id"), F.expr("CASE WHEN id % 2 = 0 THEN 'reject' ELSE 'approve' END").alias("verdict"), F.col("trust_score").alias("confidence"))
    return writes.review(candidates, verdicts, automatic=("src1", "src2"))
