"""Aggregates over facts, heat, votes and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import relation, table
from .registry import query


@query("SELECT category, count(*) AS facts FROM facts GROUP BY category", "facts")
def h1_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").groupBy("category").agg(F.count("*").alias("facts"))


@query(
    "SELECT category, count(*) AS facts, round(avg(trust_score), 6) AS mean_trust, CAST(sum(CASE WHEN trust_score >= 0.5E0 THEN 1 ELSE 0 END) AS BIGINT) AS trusted FROM facts WHERE archived = 0 GROUP BY category",
    "facts",
)
def h2_trust_stats(spark: SparkSession, folder: str) -> DataFrame:
    active = relation(spark, folder, "facts").where("archived = 0")
    return active.groupBy("category").agg(F.count("*").alias("facts"), F.round(F.avg("trust_score"), 6).alias("mean_trust"), F.count_if(F.col("trust_score") >= 0.5).alias("trusted"))


@query(
    "SELECT coalesce(lane, '*') AS lane, count(*) AS memories, CAST(sum(CASE WHEN salience < 0.2E0 THEN 1 ELSE 0 END) AS BIGINT) AS faded, round(avg(salience), 3) AS mean FROM salience GROUP BY GROUPING SETS ((), (lane))",
    "salience",
)
def h3_salience_stats(spark: SparkSession, folder: str) -> DataFrame:
    grouped = relation(spark, folder, "salience").rollup("lane").agg(F.count("*").alias("memories"), F.count_if(F.col("salience") < 0.2).alias("faded"), F.round(F.avg("salience"), 3).alias("mean"))
    return grouped.withColumn("lane", F.coalesce("lane", F.lit("*")))


@query(
    """SELECT count(*) AS total, CAST(coalesce(sum(CASE WHEN salience < 0.3E0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS low,
 CAST(coalesce(sum(CASE WHEN access_count <= 1 AND salience < 0.25E0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS faded,
 coalesce(sum(CASE WHEN salience < 0.3E0 THEN 1 ELSE 0 END), 0) >= 5 AS many_low, count(*) > 200 AS crowded FROM salience""",
    "salience",
)
def h5_health_audit(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("salience")
    counts = relation(spark, folder, "salience").agg(F.count("*").alias("total"), F.count_if(s < 0.3).alias("low"), F.count_if((F.col("access_count") <= 1) & (s < 0.25)).alias("faded"))
    return counts.withColumns({"many_low": F.col("low") >= 5, "crowded": F.col("total") > 200})


@query("SELECT coalesce(memory_tier, 'semantic') AS tier, count(*) AS facts FROM facts GROUP BY 1", "facts")
def h7_tier_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").groupBy(F.coalesce("memory_tier", F.lit("semantic")).alias("tier")).agg(F.count("*").alias("facts"))


@query("SELECT coalesce(agent_id, 'local') AS agent, profile, memory_tier, count(*) AS facts FROM facts GROUP BY ROLLUP (coalesce(agent_id, 'local'), profile, memory_tier)", "facts")
def h8_awareness(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").withColumn("agent", F.coalesce("agent_id", F.lit("local")))
    return facts.rollup("agent", "profile", "memory_tier").agg(F.count("*").alias("facts"))


@query(
    """SELECT query, count(*) AS searches, round(avg(hit_count), 6) AS mean_hits, CAST(sum(CASE WHEN hit_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty
 FROM query_log WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY query""",
    "query_log",
)
def h10_evolve_report(spark: SparkSession, folder: str) -> DataFrame:
    log = relation(spark, folder, "query_log")
    newest = log.agg(F.max("ts").alias("newest"))
    recent = log.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAY"))  # one row
    return recent.groupBy("query").agg(F.count("*").alias("searches"), F.round(F.avg("hit_count"), 6).alias("mean_hits"), F.count_if(F.col("hit_count") == 0).alias("empty"))


@query(
    """SELECT user_id, session_id, turns, last_s FROM (SELECT user_id, session_id, count(*) AS turns, max(ts_s) AS last_s,
 row_number() OVER (PARTITION BY user_id ORDER BY max(ts_s) DESC, session_id) AS rn FROM turns GROUP BY user_id, session_id) t WHERE rn <= 5""",
    "turns",
)
def h16_latest_sessions(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.pairs import latest_of

    sessions = relation(spark, folder, "turns").groupBy("user_id", "session_id").agg(F.count("*").alias("turns"), F.max("ts_s").alias("last_s"))
    return latest_of(sessions, "user_id", [F.desc("last_s"), "session_id"], 5).drop("rn")


@query(
    """SELECT query, v[1 + CAST(floor(len(v) * 0.5E0) AS INT)] AS p50, v[least(len(v), 1 + CAST(floor(len(v) * 0.95E0) AS INT))] AS p95
 FROM (SELECT query, list(latency ORDER BY latency) AS v FROM query_log GROUP BY query) t""",
    "query_log",
)
def h19_latency(spark: SparkSession, folder: str) -> DataFrame:
    """The value at place floor(n p) in order, by ranks rather than by gathering a query's log."""
    from pyspark.sql import Window

    log = relation(spark, folder, "query_log").select("query", "latency").where("latency IS NOT NULL")
    sizes = log.groupBy("query", "latency").agg(F.count("*").alias("c"))  # rows of one value count once
    order = Window.partitionBy("query").orderBy("latency")
    placed = sizes.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy("query")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("latency")))
    return placed.groupBy("query").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT CAST(floor(id / 100) AS BIGINT) AS range, count(*) AS facts, min(recorded_s) AS first_s, max(recorded_s) AS last_s FROM facts GROUP BY 1", "facts")
def h13_range_stats(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").groupBy(F.floor(F.col("id") / 100).alias("range")).agg(F.count("*").alias("facts"), F.min("recorded_s").alias("first_s"), F.max("recorded_s").alias("last_s"))
