"""Queries over the index of three-character grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings
from ..sources.tables import relation
from .registry import query

#: Postings of the texts of a relation t (id, low), by all their places.
SQL_POSTINGS = """SELECT id, gram, (length(low) - length(replace(low, gram, ''))) / 3 AS tf, length(low) - 2 AS length FROM
 (SELECT DISTINCT id, substring(low, CAST(k AS BIGINT), 3) AS gram FROM (SELECT id, low, unnest(range(1, length(low) - 1)) AS k FROM t WHERE length(low) >= 3) u) v JOIN t USING (id)"""
TURN = "session_id * 1000 + turn"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "turns").select(F.expr(TURN).alias("id"), "role", "content")


@query(f"WITH t AS (SELECT {TURN} AS id, lower(content) AS low FROM turns) SELECT id, gram, CAST(tf AS BIGINT) AS tf, CAST(length AS BIGINT) AS length FROM ({SQL_POSTINGS}) p", "turns")
def k7_postings(spark: SparkSession, folder: str) -> DataFrame:
    """All postings of an index of turns."""
    return postings.build(_turns(spark, folder), "id", "content").postings.select("id", "gram", "tf", "length")


@query(
    f"""WITH t AS (SELECT {TURN} AS id, lower(CASE WHEN ({TURN}) % 5 = 0 THEN concat(role, ' says: ', content) ELSE content END) AS low FROM turns WHERE ({TURN}) % 7 <> 1),
 p AS ({SQL_POSTINGS}) SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(sum(length) AS BIGINT) AS places FROM p GROUP BY gram""",
    "turns",
)
def k9_index_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of an index that followed the store: two thirds of the turns indexed, then the others inserted, a fifth of all updated, a seventh deleted."""
    turns, i = _turns(spark, folder), F.col("id")
    index = postings.build(turns.where(i % 3 != 0), "id", "content")
    rows = turns.where(((i % 3 == 0) | (i % 5 == 0)) & (i % 7 != 1)).withColumn("content", F.when(i % 5 == 0, F.concat("role", F.lit(" says: "), "content")).otherwise(F.col("content")))
    index = postings.changed(index, rows, turns.where(i % 7 == 1).select("id"), "id", "content")
    sums = index.postings.groupBy("gram").agg(F.sum("tf").alias("occurrences"), F.sum("length").alias("places"))
    return index.terms.select("gram", "df").join(sums, "gram", "full")


@query(
    f"WITH t AS (SELECT id, lower(fact_value) AS low FROM (SELECT * FROM facts WHERE archived = 0 ORDER BY recorded_s DESC, id LIMIT 2000) f), p AS ({SQL_POSTINGS}) SELECT gram, count(*) AS df, CAST(max(tf) AS BIGINT) AS most, CAST(min(length) AS BIGINT) AS least FROM p GROUP BY gram",
    "facts",
)
def a14_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of an index filled from a snapshot of the store, its latest 2000 memories at a time."""
    latest = relation(spark, folder, "facts").where("archived = 0").orderBy(F.desc("recorded_s"), "id").limit(2000)
    return postings.build(latest, "id", "fact_value").terms.select("gram", "df", "most", "least")


@query(
    f"""WITH t AS (SELECT {TURN} AS id, lower(content) AS low FROM turns), p AS ({SQL_POSTINGS}), stats AS (SELECT count(*) AS n, avg(greatest(length(low) - 2, 0)) AS mean FROM t), df AS (SELECT gram, count(*) AS df FROM p GROUP BY gram),
 q AS (SELECT DISTINCT qid, substring(low, CAST(k AS BIGINT), 3) AS gram FROM (SELECT id AS qid, substring(low, 1, 60) AS low, unnest(range(1, length(substring(low, 1, 60)) - 1)) AS k FROM t WHERE id % 50 = 0 AND length(low) >= 3) u),
 s AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5E0) / (df + 0.5E0)) * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * length / mean))) AS score FROM q JOIN p USING (gram) JOIN df USING (gram), stats GROUP BY qid, id)
 SELECT qid, id, round(score, 6) AS score, rn FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rn FROM s) r WHERE rn <= 10""",
    "turns",
)
def d4_bm25_many(spark: SparkSession, folder: str) -> DataFrame:
    """The heads of the turns of an id divisible by 50 as queries, all at once, over an index of all turns."""
    turns = _turns(spark, folder)
    asked = turns.where("id % 50 = 0").select(F.col("id").alias("qid"), F.substring(F.lower("content"), 1, 60).alias("query"))
    return postings.bm25_many(postings.build(turns, "id", "content"), asked, 10).select("qid", "id", F.round("score", 6).alias("score"), "rn")
