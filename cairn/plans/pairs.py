"""Conflicts, contradictions, scenes and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import pairs
from ..sources.tables import AS_OF, relation
from .registry import query
from .textual import SQL_JACCARD, sql_grams

RULES = [("thing", "nthe"), ("heat", "shed"), ("license", "token")]
SQL_RULES = "(VALUES (0, 'thing', 'nthe'), (1, 'heat', 'shed'), (2, 'license', 'token')) r(rule, p, n)"
#: A row for each fact and fact in conflict with it, with the least rule.
CONFLICTS = f"""SELECT f.id, f.o, min(f.rule) AS rule FROM (SELECT a.id, b.id AS o, rule FROM facts a JOIN {SQL_RULES} ON contains(a.fact_value, p) JOIN facts b ON b.category = a.category AND b.id <> a.id AND contains(b.fact_value, n)
 UNION ALL SELECT b.id, a.id, rule FROM facts a JOIN {SQL_RULES} ON contains(a.fact_value, p) JOIN facts b ON b.category = a.category AND b.id <> a.id AND contains(b.fact_value, n)) f GROUP BY 1, 2"""


@query(f"SELECT id, count(*) AS conflicts, min(rule) AS rule FROM ({CONFLICTS}) c GROUP BY id", "facts")
def i1_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """With how many facts of its category each fact is in conflict, and by which rule first."""
    return pairs.conflict_counts(*pairs.conflicts(relation(spark, folder, "facts"), RULES, "category", "fact_value"))


@query(
    f"SELECT id, round(trust_score * pow(0.5E0, coalesce(k, 0)), 9) AS penalised FROM facts LEFT JOIN (SELECT id, count(*) AS k FROM ({CONFLICTS}) x GROUP BY id) c USING (id)",
    "facts",
)
def i2_penalty(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts")
    found = pairs.conflict_counts(*pairs.conflicts(facts, RULES, "category", "fact_value"))
    return pairs.penalise(facts.select("id", F.col("trust_score").alias("salience")), found).select("id", F.round("penalised", 9).alias("penalised"))


@query(
    f"""WITH r AS (SELECT id, category, list_distinct(regexp_extract_all(fact_value, '[A-Z][a-z]+')) AS e, list_distinct(regexp_extract_all(lower(fact_value), '[a-z]{{2,}}')) AS t FROM
 (SELECT *, row_number() OVER (PARTITION BY category ORDER BY recorded_s DESC, id DESC) AS rn FROM facts) x WHERE rn <= 50),
 p AS (SELECT a.id AS a, b.id AS b, {SQL_JACCARD.format('a.e', 'b.e')} AS o, {SQL_JACCARD.format('a.t', 'b.t')} AS j FROM r a JOIN r b ON a.category = b.category AND a.id < b.id)
 SELECT a, b, round(o, 6) AS entity_overlap, round(o * (1 - j), 6) AS score FROM p WHERE o >= 0.3E0 AND o * (1 - j) >= 0.15E0""",
    "facts",
)
def i4_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.contradictions(relation(spark, folder, "facts"), lambda v: text.matches(v, "[A-Z][a-z]+"))
    return found.select("a", "b", F.round("entity_overlap", 6).alias("entity_overlap"), F.round("score", 6).alias("score"))


@query(
    f"""WITH r AS (SELECT category, id, rn, {sql_grams('fact_value', 2)} AS g FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY recorded_s DESC, id DESC) AS rn FROM facts) x WHERE rn <= 100),
 p AS (SELECT a.category, a.id, {SQL_JACCARD.format('a.g', 'b.g')} AS s, b.rn, b.id AS m FROM r a JOIN r b ON a.category = b.category AND b.rn < a.rn)
 SELECT category, id, arg_max(m, (s, -rn)) AS match_id, round(max(s), 6) AS similarity FROM p GROUP BY category, id HAVING max(s) >= 0.25E0""",
    "facts",
)
def i5_scenes(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.scenes(relation(spark, folder, "facts")).select("category", "id", "match_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""SELECT category, count(DISTINCT fact_key) AS keys, max(recorded_s) AS newest_s FROM facts WHERE archived = 0 AND (valid_to_s IS NULL OR valid_to_s >= {AS_OF}) AND category NOT IN ('src0', 'src1') GROUP BY category HAVING count(DISTINCT fact_key) >= 3
 ORDER BY 2 DESC, 1 LIMIT 20""",
    "facts",
)
def i6_crystallise(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.crystallise(relation(spark, folder, "facts"), AS_OF, ["src0", "src1"])


@query(
    """SELECT category, count(*) AS memories, sha256(array_to_string(list_slice(list(content ORDER BY memory_id), 1, 5), chr(10))) AS examples FROM (SELECT id AS memory_id, coalesce(CASE WHEN id % 3 = 0 THEN category END, CASE WHEN id % 3 = 1 THEN profile END, 'general') AS category, fact_value AS content FROM facts) t
 GROUP BY category HAVING count(*) >= 3""",
    "facts",
)
def i9_instincts(spark: SparkSession, folder: str) -> DataFrame:
    """What memories of one kind have in common, by category, else source, with their first contents."""
    i = F.col("id")
    rows = relation(spark, folder, "facts").select(i.alias("memory_id"), F.when(i % 3 == 0, F.col("category")).alias("category"), F.when(i % 3 == 1, F.col("profile")).alias("source"), F.col("fact_value").alias("content"))
    return pairs.instincts(rows)[0].select("category", "memories", F.sha2(F.array_join("examples", "\n"), 256).alias("examples"))


