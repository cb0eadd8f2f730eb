"""Names of a large vocabulary in the texts of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vocabulary
from ..sources.tables import relation, table
from .registry import query

#: Runs of words of each benchmark passage that are names: (first word, number of words). They overlap one another.
RUNS = ((1, 2), (2, 3), (3, 5), (5, 10), (9, 3))
SQL_RUNS = ", ".join(f"{{'k': {k}, 'n': {n}}}" for k, n in RUNS)
SQL_FOUND = rf"""v AS (SELECT DISTINCT item_id, array_to_string(w[r.k : r.k + r.n - 1], ' ') AS name FROM (SELECT item_id, w, unnest([{SQL_RUNS}]) AS r FROM (SELECT item_id, regexp_extract_all(lower(text), '{vocabulary.WORD}') AS w FROM benchmark) b) x WHERE len(w) >= r.k + r.n - 1),
 p AS (SELECT id, unnest(range(CAST(len(w) AS BIGINT))) AS pos, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) + 1), lambda i: w[i : i + 9])) AS g FROM (SELECT id, regexp_extract_all(lower(fact_value), '{vocabulary.WORD}') AS w FROM facts) t),
 k AS (SELECT id, pos, n, array_to_string(g[1 : n], ' ') AS name FROM p, (SELECT DISTINCT unnest([{", ".join(str(n) for _, n in RUNS)}]) AS n) s WHERE len(g) >= n),
 m AS (SELECT id, pos, max(n) AS n, arg_max(name, n) AS name FROM k WHERE name IN (SELECT name FROM v) GROUP BY id, pos),
 j AS MATERIALIZED (SELECT id, pos, min(pos) OVER (PARTITION BY id ORDER BY pos RANGE BETWEEN n FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM m),
 f AS (SELECT id, min(pos) AS pos FROM m GROUP BY id UNION ALL SELECT j.id, j.nx FROM f JOIN j ON j.id = f.id AND j.pos = f.pos WHERE j.nx IS NOT NULL)"""


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, name): the runs of words of passages, of those that are long enough for them."""
    rows = table(spark, folder, "benchmark").select("item_id", vocabulary.words(F.col("text")).alias("w"))
    runs = F.explode(F.array(*[F.when(F.size("w") >= k + n - 1, F.array_join(F.slice("w", k, n), " ")) for k, n in RUNS]))
    return rows.select("item_id", runs.alias("name")).where("name IS NOT NULL")


def values(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").select("id", F.col("fact_value").alias("value"))


@query(f"""WITH RECURSIVE {SQL_FOUND} SELECT m.id, CAST(m.pos AS INTEGER) AS "at", CAST(m.n AS INTEGER) AS n, m.name FROM m JOIN f ON f.id = m.id AND f.pos = m.pos""", "facts")
def c17_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Where each fact holds a name of the vocabulary: the leftmost, then the longest."""
    return vocabulary.find_names(values(spark, folder), names(spark, folder))


@query(
    f"""WITH RECURSIVE {SQL_FOUND} SELECT m.name, count(DISTINCT m.id) AS facts, m.name IN (SELECT name FROM v WHERE item_id % 2 = 0) AS known FROM m JOIN f ON f.id = m.id AND f.pos = m.pos GROUP BY m.name""",
    "facts",
)
def e6_link_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the vocabulary with their facts, and whether they were entities before: those of every other passage were."""
    found = names(spark, folder)
    new, edges = vocabulary.link_names(values(spark, folder), found, found.where("item_id % 2 = 0"))
    counts = edges.groupBy("name").agg(F.count("*").alias("facts"))
    return counts.join(new.withColumn("new", F.lit(True)), "name", "left").select("name", "facts", F.col("new").isNull().alias("known"))
