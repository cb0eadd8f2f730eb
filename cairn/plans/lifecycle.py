"""Decay, evolution, expiry, merging and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..sources.tables import AS_OF, DAY, relation, table
from .registry import query

#: The time at which heat is looked at: 40 days after the first event.
HEAT_AS_OF = 1_704_067_200 + 40 * DAY
SQL_LANES = "CASE lane WHEN 'identity' THEN 0E0 WHEN 'preference' THEN 0E0 WHEN 'procedural' THEN 0.3E0 WHEN 'lesson' THEN 0.5E0 ELSE 1E0 END"
HEAT = "(SELECT memory_id, access_count, salience, lane, CAST(floor(epoch(last_access)) AS BIGINT) AS last_s FROM salience) h"


def heat(spark: SparkSession, folder: str) -> DataFrame:
    last = F.unix_seconds(F.col("last_access").cast("timestamp"))
    return relation(spark, folder, "salience").select("memory_id", "access_count", "salience", "lane", last.alias("last_s"))


@query(
    f"""SELECT memory_id, round(d, 6) AS decayed, d < 0.2E0 AND idle > 30 * 86400 AS evicted FROM (SELECT memory_id, greatest({HEAT_AS_OF} - last_s, 0) AS idle,
 salience * exp(-ln(2) / 30E0 * ({SQL_LANES}) * greatest({HEAT_AS_OF} - last_s, 0) / 86400E0) AS d FROM {HEAT}) t""",
    "salience",
)
def g3_decay(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.decay_all(heat(spark, folder), HEAT_AS_OF).select("memory_id", F.round("decayed", 6).alias("decayed"), "evicted")


@query(
    f"""SELECT memory_id, round(least(salience + CASE change WHEN 'rise' THEN least(0.05E0, (access_count - 5) * 0.01E0) WHEN 'fall' THEN -0.03E0 ELSE 0E0 END, 1E0), 6) AS evolved, change FROM
 (SELECT *, CASE WHEN access_count >= 5 AND salience < 0.9E0 THEN 'rise' WHEN last_s < {HEAT_AS_OF} - 14 * 86400 AND salience > 0.25E0 THEN 'fall' ELSE 'none' END AS change FROM {HEAT}) t""",
    "salience",
)
def g6_evolution(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.evolution_cycle(heat(spark, folder), HEAT_AS_OF).select("memory_id", F.round("evolved", 6).alias("evolved"), "change")


@query(f"SELECT id, coalesce(valid_to_s < {AS_OF} AND archived = 0, false) AS expired, CASE WHEN coalesce(valid_to_s < {AS_OF}, false) THEN 1 ELSE archived END AS archived FROM facts", "facts")
def g10_expire(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.expire(relation(spark, folder, "facts"), AS_OF).select("id", "expired", "archived")


@query("SELECT id, 'added' AS change FROM facts WHERE archived = 0 AND recorded_s > 1730000000 UNION ALL SELECT id, 'archived' FROM facts WHERE archived = 1 AND recorded_s > 1730000000", "facts")
def g11_delta(spark: SparkSession, folder: str) -> DataFrame:
    recent = relation(spark, folder, "facts").where("recorded_s > 1730000000")
    return recent.select("id", F.when(F.col("archived") == 0, "added").otherwise("archived").alias("change"))


@query(
    f"""SELECT id, row_number() OVER (PARTITION BY split_part(split_part(fact_key, ':', 1), '_', 1), substring(lower(trim(fact_value)), 1, 30) ORDER BY length(fact_value) DESC, fact_key, id) = 1 AS stays
 FROM facts WHERE archived = 0 AND recorded_s BETWEEN {AS_OF} - 200 * 86400 AND {AS_OF}""",
    "facts",
)
def g12_dream_merge(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.dream_merge(relation(spark, folder, "facts"), AS_OF - 200 * DAY, AS_OF).select("id", "stays")


SQL_REFS = """SELECT 'facts' AS name, id FROM facts UNION ALL SELECT 'types', doc_id FROM labels UNION ALL SELECT 'raw', doc_id FROM documents"""


@query(
    """SELECT 'turns' AS name, count(*) AS rows FROM turns WHERE user_id NOT IN ('u1', 'u2') UNION ALL SELECT 'sessions', count(DISTINCT concat(user_id, ':', session_id)) FROM turns WHERE user_id NOT IN ('u1', 'u2')""",
    "turns",
)
def g15_delete_tenant(spark: SparkSession, folder: str) -> DataFrame:
    """All that two users have, gone; the default user was named without confirmation and stays."""
    turns = relation(spark, folder, "turns")
    users = spark.sql("SELECT * FROM VALUES ('u1'), ('u2'), ('u3') t(user_id)")
    tables = {"turns": turns, "sessions": turns.select("user_id", "session_id").distinct()}
    left = lifecycle.delete_tenant(tables, users, default="u3")
    return left["turns"].select(F.lit("turns").alias("name")).unionByName(left["sessions"].select(F.lit("sessions").alias("name"))).groupBy("name").agg(F.count("*").alias("rows"))


@query("SELECT id, fact_key, fact_value, trust_score FROM facts WHERE archived = 1", "facts")
def g16_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    gone = relation(spark, folder, "facts").where("archived = 1").select("id", "fact_key", "fact_value", "trust_score")
    return lifecycle.restore(lifecycle.tombstones(gone, "id", AS_OF), gone.schema)


@query(
    """SELECT wal_id, max(pos) AS pos FROM (SELECT l_orderkey AS wal_id, (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS pos, CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'done' END AS status FROM lineitem) t
 GROUP BY wal_id HAVING arg_max(status, (pos, status)) = 'pending'"""
)
def g18_pending(spark: SparkSession, folder: str) -> DataFrame:
    pos = (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    status = F.when(F.col("l_linestatus") == "O", "pending").otherwise("done")
    log = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("wal_id"), pos.alias("pos"), status.alias("status"))
    return lifecycle.pending(log)


@query("SELECT max(id) AS id, coalesce(agent_id, 'local') AS agent_id, category FROM facts GROUP BY coalesce(agent_id, 'local'), category", "facts")
def g19_latest_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").groupBy(F.coalesce("agent_id", F.lit("local")).alias("agent_id"), "category").agg(F.max("id").alias("id"))


@query("SELECT id, coalesce(agent_id, 'local') AS agent_id, coalesce(profile, 'default') AS profile, coalesce(memory_tier, 'semantic') AS memory_tier, coalesce(shared, 1) AS shared FROM facts", "facts")
def g20_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").na.fill({"agent_id": "local", "profile": "default", "memory_tier": "semantic", "shared": 1}).select("id", "agent_id", "profile", "memory_tier", "shared")


@query(
    """SELECT id, CASE WHEN nv <> fact_value THEN nr ELSE -1 END AS closed_s FROM (SELECT id, fact_value, lead(fact_value) OVER w AS nv, lead(recorded_s) OVER w AS nr FROM facts WINDOW w AS (PARTITION BY category, profile ORDER BY recorded_s, id)) t""",
    "facts",
)
def g22_override(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.close_overridden(relation(spark, folder, "facts"), ["category", "profile"]).select("id", F.coalesce("closed_s", F.lit(-1)).alias("closed_s"))


@query(
    f"""WITH RECURSIVE e AS (SELECT concat('u', CAST(user_id AS VARCHAR), ':', event_type) AS memory_id, CAST(trunc(floor(value)) AS BIGINT) % 5 AS hits, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events),
 w AS (SELECT memory_id, CAST(0 AS BIGINT) AS rn, salience AS s FROM {HEAT} UNION ALL
 SELECT w.memory_id, e.rn, least(1E0, greatest(0.05E0, w.s + CASE WHEN hits >= 3 THEN 0.15E0 WHEN hits = 0 THEN -0.12E0 ELSE 0.05E0 END)) FROM w JOIN e ON e.memory_id = w.memory_id AND e.rn = w.rn + 1)
 SELECT memory_id, round(arg_max(s, rn), 6) AS adjusted FROM w GROUP BY memory_id""",
    "salience",
)
def g5_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """A fold in order, with a clamp after each step."""
    signals = relation(spark, folder, "query_log").join(spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id"), "event_id")
    kind = F.when(F.col("hit_count") >= 3, "useful").when(F.col("hit_count") == 0, "useless").otherwise("correction")
    signals = signals.select(F.concat(F.lit("u"), "user_id", F.lit(":"), "query").alias("memory_id"), F.col("event_id").alias("seq"), kind.alias("signal"))
    return lifecycle.feedback(heat(spark, folder), signals).select("memory_id", F.round("adjusted", 6).alias("adjusted"))


@query(
    f"""SELECT user_id, memory_id, rank FROM (SELECT user_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY last_s DESC, memory_id) AS rank FROM
 (SELECT split_part(memory_id, ':', 1) AS user_id, * FROM {HEAT}) u WHERE last_s >= {HEAT_AS_OF} - 1296000 OR access_count > 2) t WHERE rank <= 3""",
    "salience",
)
def j7_working_set(spark: SparkSession, folder: str) -> DataFrame:
    items = heat(spark, folder).withColumn("user_id", F.substring_index("memory_id", ":", 1))
    return lifecycle.top_per_user(items, 3, 15 * DAY, HEAT_AS_OF).select("user_id", "memory_id", "rank")
