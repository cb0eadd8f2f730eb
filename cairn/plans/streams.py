"""Bursts of messages, and reads by cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import relation, table
from ..streaming import coalesce
from .registry import query


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as messages of users: (key, ts_s, size, seq)."""
    ts = F.col("ts").cast("timestamp").cast("double")
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), ts.alias("ts_s"), F.length("props").alias("size"), F.col("event_id").alias("seq"))


def sql_waves(key: str, time: str) -> str:
    """The fold of a buffer by recursion: how a message finds it, and whether it closes it. A row's wave ends there if it is full, or if the next message comes too late."""
    return f"""m AS (SELECT {key} AS key, {time} AS t, length(props) AS size, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
 s AS (SELECT key, rn, t AS first, t AS last, 1 AS n, size AS c, size >= 2000 AS shut, CAST(NULL AS VARCHAR) AS broke FROM m WHERE rn = 1 UNION ALL
 SELECT key, rn, CASE WHEN fresh THEN t ELSE first END, t, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN size ELSE c + size END, CASE WHEN fresh THEN 1 ELSE n + 1 END >= 8 OR CASE WHEN fresh THEN size ELSE c + size END >= 2000, broke FROM (
 SELECT m.key, m.rn, m.t, m.size, s.first, s.n, s.c, s.shut OR m.t - s.last >= 12 OR m.t - s.first >= 4 AS fresh, CASE WHEN s.shut THEN NULL WHEN m.t - s.last >= 12 THEN 'idle' WHEN m.t - s.first >= 4 THEN 'window' END AS broke
 FROM s JOIN m ON m.key = s.key AND m.rn = s.rn + 1) x),
 w AS (SELECT key, first, last, n, c, CASE WHEN shut THEN CASE WHEN n >= 8 THEN 'parts' ELSE 'chars' END WHEN next IS NULL THEN 'idle' ELSE after END AS reason FROM (
 SELECT *, lead(rn) OVER (PARTITION BY key ORDER BY rn) AS next, lead(broke) OVER (PARTITION BY key ORDER BY rn) AS after FROM s) y WHERE shut OR next IS NULL OR after IS NOT NULL)"""


@query(f"WITH RECURSIVE {sql_waves('CAST(user_id AS VARCHAR)', 'epoch(ts)')} SELECT key, first AS wave_start, last AS wave_end, n AS parts, CAST(c AS INTEGER) AS chars, reason FROM w")
def j2_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """A stateful fold; tested against a plain loop too, and against its own stream."""
    return coalesce.coalesce_batch(messages(spark, folder))


@query(
    """SELECT key, run, count(*) AS parts, CAST(sum(size) AS BIGINT) AS chars FROM (SELECT key, size, CAST(sum(opens) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM
 (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, length(props) AS size, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3600 THEN 1 ELSE 0 END AS opens FROM events) a) t GROUP BY key, run"""
)
def j8_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return coalesce.sessions(messages(spark, folder), 3600).select("key", "run", "parts", "chars")


@query("SELECT id, agent_id, memory_tier FROM facts WHERE id > 500 AND coalesce(shared, 1) = 1 AND profile = 'default' AND coalesce(agent_id, 'local') <> 'agent_a' ORDER BY id LIMIT 200", "facts")
def j4_cursor(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").where("id > 500 AND coalesce(shared, 1) = 1 AND profile = 'default' AND coalesce(agent_id, 'local') <> 'agent_a'")
    return facts.orderBy("id").limit(200).select("id", "agent_id", "memory_tier")


@query(
    """WITH m AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch(ts) AS t, event_id, length(props) AS size FROM events WHERE epoch(ts) <= 1704500000), o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id) >= 36000 THEN 1 ELSE 0 END AS opens FROM m),
 r AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o), s AS (SELECT key, run, min(t) AS a, max(t) AS b, count(*) AS parts, CAST(sum(size) AS BIGINT) AS chars FROM r GROUP BY key, run),
 l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS rn FROM s)
 SELECT key, parts, chars, round(1704500000 - a, 3) AS age_s, round(1704500000 - b, 3) AS idle_s FROM l WHERE rn = 1 AND 1704500000 - b < 36000"""
)
def k18_buffer_status(spark: SparkSession, folder: str) -> DataFrame:
    """The buffers that are open at a time."""
    found = coalesce.buffer_status(messages(spark, folder), 1_704_500_000, 36_000)
    return found.select("key", "parts", "chars", F.round("age_s", 3).alias("age_s"), F.round("idle_s", 3).alias("idle_s"))


@query(
    """WITH m AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch(ts) AS t, event_id FROM events WHERE epoch(ts) <= 1704500000), o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id) >= 7200 THEN 1 ELSE 0 END AS opens FROM m),
 r AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o), s AS (SELECT key, run, min(t) AS a, max(t) AS b, count(*) AS parts FROM r GROUP BY key, run),
 l AS (SELECT * FROM s WHERE 1704500000 - b < 7200 ORDER BY b DESC, key LIMIT 40), h AS (SELECT r.*, row_number() OVER (PARTITION BY r.key ORDER BY t DESC, event_id DESC) AS n FROM r JOIN l ON l.key = r.key AND l.run = r.run)
 SELECT l.key, parts, round(a, 3) AS start_s, round(b, 3) AS last_s, (SELECT string_agg(event_id, ',' ORDER BY t, event_id) FROM h WHERE h.key = l.key AND n <= 3) AS history FROM l"""
)
def j8_live_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The forty latest sessions that are open at a time, with their last three messages."""
    found = coalesce.live_sessions(messages(spark, folder), 1_704_500_000, 7_200, 40, 3)
    history = F.array_join(F.transform("history", lambda s: s.cast("string")), ",")
    return found.select("key", "parts", F.round("start_s", 3).alias("start_s"), F.round("last_s", 3).alias("last_s"), history.alias("history"))
