"""The relations of a memory store, projected from a folder of Parquet tables.

Each projection is one SELECT that Spark and other engines read alike; `STRING` is the only word that others spell differently.
Times are whole epoch seconds, so that every query takes its own `as_of` and none reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2025-01-01 UTC, the time at which the projected store is looked at.
AS_OF = 1_735_689_600
DAY = 86_400

RELATIONS = {
    "facts": ("documents", """SELECT doc_id AS id, source AS category, concat('doc:', CAST(doc_id AS STRING)) AS fact_key,
 text AS fact_value,
 CASE doc_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'agent_a' WHEN 2 THEN 'agent_b' ELSE NULL END AS agent_id,
 CASE WHEN doc_id % 5 = 0 THEN 'team_b' ELSE 'default' END AS profile,
 CASE doc_id % 3 WHEN 0 THEN 'procedural' WHEN 1 THEN 'semantic' ELSE 'episodic' END AS memory_tier,
 CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS trust_score,
 CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END AS shared,
 CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS archived,
 1704067200 + ((doc_id * 7919) % 8760) * 3600 AS recorded_s,
 CASE WHEN doc_id % 7 = 0 THEN 1704067200 + ((doc_id * 7919) % 8760) * 3600 + 2592000 ELSE NULL END AS valid_to_s,
 CASE WHEN doc_id % 11 = 0 THEN 1704067200 + ((doc_id * 104729) % 17520) * 3600 ELSE NULL END AS valid_from_s
FROM documents"""),
    "turns": ("conversations", """SELECT concat('u', CAST(conv_id % 10 AS STRING)) AS user_id, conv_id AS session_id, turn, role,
 1704067200 + conv_id * 3600 + turn * 30 AS ts_s, text AS content FROM conversations"""),
    "salience": ("events", """SELECT concat('u', CAST(user_id AS STRING), ':', event_type) AS memory_id, count(*) AS access_count,
 least(1E0, CAST(count(*) AS DOUBLE) / 20) AS salience,
 CASE event_type WHEN 'signup' THEN 'identity' WHEN 'purchase' THEN 'preference' WHEN 'click' THEN 'procedural' WHEN 'error' THEN 'lesson' ELSE 'general' END AS lane,
 max(ts) AS last_access FROM events GROUP BY user_id, event_type"""),
    "opinions": ("lineitem", """SELECT fact_id, source, stance, confidence FROM (
 SELECT l_partkey AS fact_id, l_suppkey AS source, CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN 'oppose' ELSE 'neutral' END AS stance,
 l_discount * 10 AS confidence, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) t WHERE rn = 1"""),
    "entities": ("part", "SELECT p_partkey AS entity_id, p_brand AS name, p_type AS entity_type FROM part"),
    "fact_entities": ("lineitem", "SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS entity_id FROM lineitem"),
    "order_facts": ("orders", "SELECT o_orderkey AS id, o_totalprice / 500000 AS trust_score, o_orderpriority AS category FROM orders"),
    "query_log": ("events", "SELECT event_id, event_type AS query, CAST(floor(value) AS INT) % 5 AS hit_count, value AS latency, ts FROM events"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One relation of RELATIONS, over the folder's table."""
    base, select = RELATIONS[name]
    return spark.sql(select.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: table(spark, folder, base)})


def with_relations(sql: str, *names: str) -> str:
    """SQL for an engine that has the base tables as views: the relations as common table expressions, then sql."""
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({RELATIONS[n][1].replace('STRING', 'VARCHAR')})" for n in names)
    sql = sql.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(head):
            return f"{head}{ctes}, {sql[len(head):]}"
    return f"WITH {ctes} {sql}"
