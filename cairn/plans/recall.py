"""Search and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import recall
from ..sources.tables import AS_OF, DAY, relation, table
from .registry import query
from .textual import SQL_JACCARD, SQL_WORDS, sql_grams

SQL_COSINE = "list_sum(list_transform(range(1, CAST(len(a) AS BIGINT) + 1), lambda i: a[i] * b[i]))"
SQL_TIER = f"""(CASE memory_tier WHEN 'procedural' THEN 1E0 WHEN 'semantic' THEN 0.85E0 ELSE 0.7E0 END) * (CASE memory_tier WHEN 'procedural' THEN 1E0
 ELSE exp(-ln(2) * (greatest({AS_OF} - recorded_s, 0) / 86400E0) / CASE memory_tier WHEN 'semantic' THEN 180E0 ELSE 30E0 END) END) * (CASE WHEN coalesce(trust_score, 0) = 0 THEN 0.5E0 ELSE trust_score END)"""


@query(
    f"""SELECT qid, vec_id, round(score, 6) AS score, rn FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rn FROM
 (SELECT qid, vec_id, {SQL_COSINE} / (sqrt({SQL_COSINE.replace('b[', 'a[')}) * sqrt({SQL_COSINE.replace('a[i] *', 'b[i] *')})) AS score FROM (SELECT q.vec_id AS qid, e.vec_id, CAST(e.embedding AS DOUBLE[]) AS a, CAST(q.embedding AS DOUBLE[]) AS b
 FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) p) s) t WHERE rn <= 30"""
)
def d1_vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return recall.vector_topk(vectors, queries, 30).select("qid", "vec_id", F.round("score", 6).alias("score"), "rn")


@query("SELECT id, fact_key FROM facts WHERE contains(lower(fact_value), 'license') OR contains(lower(fact_value), 'token') ORDER BY trust_score DESC, id LIMIT 50", "facts")
def d2_keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return recall.keyword_search(relation(spark, folder, "facts"), ["license", "token"], "fact_value", 50, [F.desc("trust_score"), "id"]).select("id", "fact_key")


@query(
    f"""WITH grams AS (SELECT unnest({sql_grams("'therein inand'", 3)}) AS gram),
 docs AS (SELECT session_id * 1000 + turn AS id, lower(content) AS low, greatest(length(content) - 2, 0) AS length FROM turns), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM docs),
 post AS (SELECT id, length, gram, (length(low) - length(replace(low, gram, ''))) / 3E0 AS tf FROM docs, grams WHERE contains(low, gram)), df AS (SELECT gram, count(*) AS df FROM post GROUP BY gram)
 SELECT id, round(score, 6) AS score FROM (SELECT id, sum(ln(1 + (n - df + 0.5E0) / (df + 0.5E0)) * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * length / mean))) AS score FROM post JOIN df USING (gram), stats GROUP BY id) s
 ORDER BY round(score, 9) DESC, id LIMIT 40""",
    "turns",
)
def d4_bm25(spark: SparkSession, folder: str) -> DataFrame:
    turns = relation(spark, folder, "turns").withColumn("id", F.col("session_id") * 1000 + F.col("turn"))
    return recall.bm25(turns, "therein inand", "id", "content", 40).select("id", F.round("score", 6).alias("score"))


@query(
    f"""SELECT id, fact_key, trust_score, stale, exact FROM (SELECT *, CASE WHEN coalesce(valid_to_s < {AS_OF}, false) OR coalesce(valid_from_s > {AS_OF}, false) THEN 2 ELSE 0 END AS stale,
 CASE WHEN fact_key = 'src1' THEN 0 WHEN category = 'src1' THEN 1 ELSE 2 END AS exact FROM facts WHERE (contains(lower(category), 'src1') OR contains(lower(fact_key), 'src1') OR contains(lower(fact_value), 'src1')) AND trust_score >= 0.2E0) t
 ORDER BY stale, exact, trust_score DESC, recorded_s DESC, id LIMIT 25""",
    "facts",
)
def d5_structured_search(spark: SparkSession, folder: str) -> DataFrame:
    return recall.structured(relation(spark, folder, "facts"), "src1", AS_OF, 25).select("id", "fact_key", "trust_score", "stale", "exact")


@query(f"SELECT id, round({SQL_TIER}, 6) AS fed_score FROM facts WHERE archived = 0", "facts")
def d7_tier_score(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").where("archived = 0")
    return recall.by_tier(facts, AS_OF).select("id", F.round("fed_score", 6).alias("fed_score"))


@query(
    f"""WITH placed AS (SELECT id, {SQL_TIER} AS fed_score, CASE WHEN coalesce(agent_id, 'local') = 'agent_b' THEN 1 WHEN coalesce(shared, 1) = 1 AND profile = 'team_b' THEN 2 WHEN coalesce(shared, 1) = 1 THEN 3 END AS rung FROM facts WHERE archived = 0),
 n AS (SELECT count(*) FILTER (WHERE rung = 1) AS a, count(*) FILTER (WHERE rung = 2) AS b FROM placed)
 SELECT id, rung, round(fed_score, 6) AS fed_score FROM placed, n WHERE rung <= CASE WHEN a >= 300 THEN 1 WHEN a + b >= 300 THEN 2 ELSE 3 END ORDER BY placed.fed_score DESC, id LIMIT 500""",
    "facts",
)
def d8_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return recall.ladder(relation(spark, folder, "facts"), "agent_b", "team_b", AS_OF, 500).select("id", "rung", F.round("fed_score", 6).alias("fed_score"))


@query(
    f"""WITH top AS (SELECT id, fact_value, {SQL_TIER} AS s FROM facts WHERE archived = 0 ORDER BY 3 DESC, id LIMIT 100), placed AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS place,
 list_distinct(list_concat({sql_grams('lower(trim(fact_value))', 2)}, {SQL_WORDS.format('trim(fact_value)')})) AS a, list_distinct(list_concat({sql_grams("'the thin and'", 2)}, {SQL_WORDS.format("'the thin and'")})) AS b FROM top)
 SELECT id, place, round(CASE WHEN place <= 60 THEN 0.6E0 * ({SQL_JACCARD.format('a', 'b')}) + 0.4E0 * s ELSE s END, 6) AS reranked FROM placed""",
    "facts",
)
def d9_rerank(spark: SparkSession, folder: str) -> DataFrame:
    top = recall.by_tier(relation(spark, folder, "facts").where("archived = 0"), AS_OF).orderBy(F.desc("fed_score"), "id").limit(100)
    return recall.rerank(top, "the thin and", "fed_score", 60, "fact_value").select("id", "place", F.round("reranked", 6).alias("reranked"))


@query(
    f"""SELECT id, round(0.35E0 * trust_score + 0.25E0 * (len(list_filter(['the', 'and'], lambda t: contains(fact_value, t))) / 2E0) + 0.15E0 * exp(-0.05E0 * (({AS_OF} - recorded_s) / 86400E0)) + 0.1E0 * coalesce(trust_score, 0.5E0)
 + 0.15E0 * least((id % 120) / 100E0, 1E0), 6) AS score FROM facts""",
    "facts",
)
def d10_five_signals(spark: SparkSession, folder: str) -> DataFrame:
    age = (AS_OF - F.col("recorded_s")) / DAY
    terms = F.array(F.lit("the"), F.lit("and"))
    score = scores.recall_score(F.col("trust_score"), text.coverage(F.col("fact_value"), terms), age, F.col("trust_score"), F.col("id") % 120)
    return relation(spark, folder, "facts").select("id", F.round(score, 6).alias("score"))


@query(
    f"""WITH top AS (SELECT id, fact_value, trust_score FROM facts WHERE category = 'src2' ORDER BY trust_score DESC, id LIMIT 60), s AS (SELECT id, 0.6E0 * ({SQL_JACCARD.format('a', 'b')}) + 0.4E0 * least(greatest(trust_score, 0E0), 1E0) AS combined FROM
 (SELECT *, list_distinct(list_concat({sql_grams('lower(trim(fact_value))', 2)}, {SQL_WORDS.format('trim(fact_value)')})) AS a, list_distinct(list_concat({sql_grams("'that the thin and on'", 2)}, {SQL_WORDS.format("'that the thin and on'")})) AS b FROM top) t)
 SELECT id, round(combined, 6) AS combined, row_number() OVER (ORDER BY round(combined, 9) DESC, id) <= 8 AND combined >= 0.4E0 AS ignited FROM s""",
    "facts",
)
def d12_ignition(spark: SparkSession, folder: str) -> DataFrame:
    top = relation(spark, folder, "facts").where("category = 'src2'").orderBy(F.desc("trust_score"), "id").limit(60)
    return recall.ignite(top, "that the thin and on", "fact_value", "trust_score", 0.4, 8).select("id", F.round("combined", 6).alias("combined"), "ignited")


@query(
    "SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY substring(fact_value, 1, 100) ORDER BY trust_score DESC, id) AS rn FROM facts WHERE archived = 0) t WHERE rn = 1", "facts"
)
def d14_dedup_by_head(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").where("archived = 0").withColumn("head", F.substring("fact_value", 1, 100))
    return recall.first_of_each(facts, ["head"], [F.desc("trust_score"), "id"]).select("id", "category")


@query(
    """SELECT category, count(*) AS lines, CAST(max(used) AS BIGINT) AS used FROM (SELECT category, sum(length(fact_key) + length(fact_value) + 5) OVER (PARTITION BY category ORDER BY trust_score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM facts) t
 WHERE used <= 40000 GROUP BY category""",
    "facts",
)
def d18_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of facts until the budget; only their lengths are put in order."""
    length = F.length(F.concat(F.lit("- "), "fact_key", F.lit(": "), "fact_value"))
    facts = relation(spark, folder, "facts").select("id", "category", "trust_score", length.alias("n"))
    kept = recall.within_budget(facts, F.col("n"), [F.desc("trust_score"), "id"], 40_000, ["category"])
    return kept.groupBy("category").agg(F.count("*").alias("lines"), F.max("used").alias("used"))


@query(
    """SELECT session_id, turn, sha256(context) AS context_hash FROM (SELECT session_id, turn, coalesce(string_agg(substring(content, 1, 200), ' | ') OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM turns) t""",
    "turns",
)
def d22_session_context(spark: SparkSession, folder: str) -> DataFrame:
    return recall.earlier_context(relation(spark, folder, "turns")).select("session_id", "turn", F.sha2("context", 256).alias("context_hash"))


@query("SELECT id, fact_value FROM (SELECT id, fact_value, row_number() OVER (PARTITION BY agent_id ORDER BY id) AS rn, agent_id FROM facts) t WHERE rn = 1 OR agent_id IS NULL", "facts")
def k3_dedup_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return recall.first_of_each(relation(spark, folder, "facts"), ["agent_id"], ["id"]).select("id", "fact_value")
