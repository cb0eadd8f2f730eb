"""Text and similarity functions over facts of one block: facts of a category with ids next to each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.grams import bigrams, multiset_similarity
from ..operators import pairs
from ..sources.tables import AS_OF, relation, table
from .registry import query

def sql_grams(text: str, n: int) -> str:
    """SQL for the distinct runs of n characters of a text."""
    chars = f"string_split({text}, '')"
    return f"list_distinct(list_transform(list_zip({', '.join([chars, *[f'{chars}[{k}:]' for k in range(2, n + 1)]])}), lambda z: {' || '.join(f'z[{k}]' for k in range(1, n + 1))}))"


NEXT = "(SELECT id, fact_value AS x, lead(fact_value) OVER (PARTITION BY category ORDER BY id) AS y FROM facts) n"
SQL_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
SQL_JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0E0 END"


def neighbours(spark: SparkSession, folder: str, *sets: Callable[[Column], Column]) -> DataFrame:
    """Each fact with the columns that sets make of its fact_value, s0, s1, ..., and those of the next fact of its category in next.

    Values are shuffled, not what is made of them: sets of grams are several times as long.
    """
    rows = relation(spark, folder, "facts").select("id", "category", "fact_value")
    met = pairs.following(rows, ["category"], "id", ["fact_value"]).where("next IS NOT NULL")
    made = lambda value: [f(value).alias(f"s{k}") for k, f in enumerate(sets)]
    return met.select("id", *made(F.col("fact_value")), F.struct(*made(F.col("next.fact_value"))).alias("next"))


@query(f"SELECT id, round({SQL_JACCARD.format('a', 'b')}, 6) AS similarity FROM (SELECT id, {SQL_WORDS.format('x')} AS a, {SQL_WORDS.format('y')} AS b FROM {NEXT} WHERE y IS NOT NULL) t", "facts")
def c1_word_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(spark, folder, text.words).select("id", F.round(text.jaccard(F.col("s0"), F.col("next.s0")), 6).alias("similarity"))


@query(
    f"""SELECT id, round({SQL_JACCARD.format('a', 'b')}, 6) AS similarity FROM (SELECT id, list_distinct(list_concat({sql_grams('x', 2)}, {SQL_WORDS.format('x')})) AS a,
 list_distinct(list_concat({sql_grams('y', 2)}, {SQL_WORDS.format('y')})) AS b FROM (SELECT id, lower(trim(x)) AS x, lower(trim(y)) AS y FROM {NEXT} WHERE y IS NOT NULL) m) t""",
    "facts",
)
def c3_gram_word_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    similarity = text.gram_word_jaccard((F.col("s0"), F.col("s1")), (F.col("next.s0"), F.col("next.s1")))
    return neighbours(spark, folder, *[lambda v, k=k: text.gram_sets(v)[k] for k in (0, 1)]).select("id", F.round(similarity, 6).alias("similarity"))


@query(f"SELECT id, round({SQL_JACCARD.format('a', 'b')}, 6) AS similarity FROM (SELECT id, {sql_grams('x', 2)} AS a, {sql_grams('y', 2)} AS b FROM {NEXT} WHERE y IS NOT NULL) t", "facts")
def c4_gram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(spark, folder, bigrams).select("id", F.round(text.jaccard(F.col("s0"), F.col("next.s0")), 6).alias("similarity"))


@query(
    f"""SELECT id, round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS similarity FROM (SELECT id, g, count(*) FILTER (WHERE s = 'x') AS a, count(*) FILTER (WHERE s = 'y') AS b FROM
 (SELECT id, 'x' AS s, unnest(list_filter(list_transform(list_zip(string_split(x, ''), string_split(x, '')[2:]), lambda z: z[1] || z[2]), lambda g: g IS NOT NULL)) AS g FROM {NEXT} WHERE y IS NOT NULL
 UNION ALL SELECT id, 'y', unnest(list_filter(list_transform(list_zip(string_split(y, ''), string_split(y, '')[2:]), lambda z: z[1] || z[2]), lambda g: g IS NOT NULL)) FROM {NEXT} WHERE y IS NOT NULL) u GROUP BY id, g) t GROUP BY id""",
    "facts",
)
def c5_gram_counts(spark: SparkSession, folder: str) -> DataFrame:
    similarity = F.round(multiset_similarity("s0", "next.s0"), 6)
    return neighbours(spark, folder, lambda v: v).select("id", similarity.alias("similarity")).where("similarity IS NOT NULL")


@query(
    f"SELECT id, round(CASE WHEN greatest(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), len(b)) ELSE 0E0 END, 6) AS similarity FROM (SELECT id, {SQL_WORDS.format('x')} AS a, {SQL_WORDS.format('y')} AS b FROM {NEXT} WHERE y IS NOT NULL) t",
    "facts",
)
def c6_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(spark, folder, text.words).select("id", F.round(text.overlap(F.col("s0"), F.col("next.s0")), 6).alias("similarity"))


@query(
    f"SELECT id, round({SQL_JACCARD.format('a', 'b')}, 6) AS similarity FROM (SELECT id, list_distinct(regexp_extract_all(x, '[a-zA-Z]{{2,}}')) AS a, list_distinct(regexp_extract_all(y, '[a-zA-Z]{{2,}}')) AS b FROM {NEXT} WHERE y IS NOT NULL) t",
    "facts",
)
def c7_token_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(spark, folder, lambda v: text.matches(v, "[a-zA-Z]{2,}")).select("id", F.round(text.jaccard(F.col("s0"), F.col("next.s0")), 6).alias("similarity"))


@query(
    """SELECT id, array_to_string(list_slice(d, 1, 16), ' ') AS terms FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM
 (SELECT id, list_filter(regexp_extract_all(lower(fact_value), '[a-z0-9_]+'), lambda t: length(t) >= 3) AS l FROM facts) a) t""",
    "facts",
)
def c8_search_terms(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").select("id", F.array_join(text.search_terms(F.col("fact_value")), " ").alias("terms"))


@query(
    """SELECT id, round(len(list_filter(['the', 'tion', 'xyz', 'ent'], lambda t: contains(fact_value, t))) / 4E0, 4) AS coverage FROM facts""",
    "facts",
)
def c11_coverage(spark: SparkSession, folder: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("the", "tion", "xyz", "ent")))
    return relation(spark, folder, "facts").select("id", text.coverage(F.col("fact_value"), terms).alias("coverage"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN '' ELSE sha256(trim(text)) END AS content_hash FROM documents")
def c14_content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT session_id, turn, sha256(concat(user_id, '|', role, '|', regexp_replace(trim(lower(content)), '\\s+', ' ', 'g'))) AS cache_key FROM turns", "turns")
def c15_cache_key(spark: SparkSession, folder: str) -> DataFrame:
    flat = F.regexp_replace(F.trim(F.lower("content")), r"\s+", " ")
    return relation(spark, folder, "turns").select("session_id", "turn", F.sha2(F.concat_ws("|", "user_id", "role", flat), 256).alias("cache_key"))


@query(
    "SELECT id, CASE WHEN s < 0 OR s IS NULL THEN 0E0 WHEN s > 1 THEN round(1 / (1 + exp(-s / 10)), 4) ELSE s END AS score FROM (SELECT id, CAST(id % 37 AS DOUBLE) / 10 - 1 AS s FROM facts) t", "facts"
)
def c22_squash(spark: SparkSession, folder: str) -> DataFrame:
    raw = (F.col("id") % 37).cast("double") / 10 - 1
    return relation(spark, folder, "facts").select("id", scores.squash(raw).alias("score"))


@query("SELECT split_part(split_part(fact_key, ':', 1), '_', 1) AS prefix, count(*) AS facts FROM facts GROUP BY 1", "facts")
def c25_key_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").groupBy(text.key_prefix(F.col("fact_key")).alias("prefix")).agg(F.count("*").alias("facts"))


@query(f"SELECT id, CASE memory_tier WHEN 'procedural' THEN -1 WHEN 'semantic' THEN recorded_s + 180 * 86400 ELSE recorded_s + 30 * 86400 END AS decay_s, recorded_s + 30 * 86400 < {AS_OF} AS old FROM facts", "facts")
def k1_decay_deadline(spark: SparkSession, folder: str) -> DataFrame:
    days = scores.choose(F.col("memory_tier"), {"semantic": 180, "episodic": 30}, None)
    facts = relation(spark, folder, "facts")
    return facts.select("id", F.coalesce(F.col("recorded_s") + days * 86400, F.lit(-1)).alias("decay_s"), (F.col("recorded_s") + 30 * 86400 < AS_OF).alias("old"))
