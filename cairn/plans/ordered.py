"""Queries whose rows depend on what earlier rows have set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import ordered
from ..sources.tables import relation, table
from .more import SQL_GATE
from .registry import query


@query(
    """WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
 w AS (SELECT event_id, user_id, event_type, rn, t AS since, true AS made FROM r WHERE rn = 1 UNION ALL
 SELECT r.event_id, r.user_id, r.event_type, r.rn, CASE WHEN r.t - w.since > 3600 THEN r.t ELSE w.since END, r.t - w.since > 3600 FROM w JOIN r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.rn = w.rn + 1)
 SELECT event_id FROM w WHERE made"""
)
def j6_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of a user and type that a cache does not have: an entry lives for an hour from its writing."""
    requests = table(spark, folder, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return ordered.cache_writes(requests, ["user_id", "event_type"], 3600).select(F.col("id").alias("event_id"))


#: Messages of a user close together, many of them short: heads of turns, a turn a few seconds after the one before.
MESSAGE_SQL = "SELECT user_id, session_id * 1000 + turn AS id, session_id * 20 + turn * 4 AS said_s, substring(content, 1, CAST(1 + (session_id * 7 + turn * 5) % 26 AS INT)) AS query FROM turns"


@query(
    f"""WITH RECURSIVE m AS (SELECT user_id, id, said_s, trim(CASE WHEN id % 11 = 3 THEN concat('remember ', query) WHEN id % 13 = 5 THEN 'thanks!' WHEN id % 17 = 2 THEN concat('wrong ', query) ELSE query END, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS q FROM ({MESSAGE_SQL}) x),
 g AS (SELECT *, length(q) AS n, CASE WHEN length(q) < 3 THEN 'query_too_short' {SQL_GATE} WHEN length(q) > 15 AND (len(regexp_extract_all(q, '{rules.CJK}')) >= 5 OR regexp_matches(q, '{rules.CONTENT_WORDS}')) THEN 'content_query' ELSE 'no_signal' END AS reason,
 row_number() OVER (PARTITION BY user_id ORDER BY said_s, id) AS rn FROM m),
 s AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS since, false AS hot, CAST(NULL AS BIGINT) AS id, '' AS decided FROM m GROUP BY user_id UNION ALL
 SELECT user_id, rn, CASE WHEN decided IN ('query_too_short', 'social_closer', 'session_followup_hot') THEN since ELSE said_s END, CASE WHEN decided IN ('query_too_short', 'social_closer', 'session_followup_hot') THEN was ELSE decided <> 'no_signal' END, id, decided FROM (
 SELECT g.user_id, g.rn, g.id, g.said_s, s.since, s.hot AS was, CASE WHEN g.reason NOT IN ('query_too_short', 'social_closer', 'correction_detected') AND s.hot AND g.said_s - s.since < 15 AND g.n < 12 THEN 'session_followup_hot' ELSE g.reason END AS decided
 FROM s JOIN g ON g.user_id = s.user_id AND g.rn = s.rn + 1) d)
 SELECT id, decided AS reason, CASE WHEN decided IN ('correction_detected', 'explicit_recall', 'reference', 'session_followup_hot') THEN 'episode' WHEN decided = 'self_reference' THEN 'identity' WHEN decided = 'content_query' THEN 'pinned' ELSE '' END AS scope,
 decided NOT IN ('query_too_short', 'social_closer', 'no_signal') AS needs_memory FROM s WHERE rn > 0""",
    "turns",
)
def j11_follow_up(spark: SparkSession, folder: str) -> DataFrame:
    """The gate's decisions on each user's messages in order: short ones soon after a decision for memory follow it."""
    rows = spark.sql(MESSAGE_SQL.replace("FROM turns", "FROM {turns}"), turns=relation(spark, folder, "turns"))
    i, q = F.col("id"), F.col("query")
    said = F.when(i % 11 == 3, F.concat(F.lit("remember "), q)).when(i % 13 == 5, "thanks!").when(i % 17 == 2, F.concat(F.lit("wrong "), q)).otherwise(q)
    out = ordered.gate_decisions(rows.withColumnRenamed("said_s", "at").withColumn("query", said))
    return out.withColumn("scope", F.coalesce("scope", F.lit("")))
