"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosstok, fingerprint, itq, licenses, lines, minhash, mixing, pii, quality, qualityrules, tokencount, trie

RANKS = "byte_bpe_50k.tiktoken"
MIX_WEIGHTS = [3.0, 1.0, 2.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"), percent=80)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token across a line's end counts where it starts."""
    docs = table(spark, sf_dir, "documents")
    return tokencount.count_by_section(docs, tokencount.line_lengths(F.col("text")), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, "start")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates_frame(spark), least=0.8)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs)).drop("found")


def op11_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crosstok.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that begin with up to eight turns of the conversation of the next lower number divisible by five."""
    number = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    nodes, whole = trie.prefix_trie(table(spark, sf_dir, "conversations"), heads=(F.col("conv") - F.col("conv") % 5, number, 8))
    ends = trie.end_digests(trie.end_texts(whole))
    digests = nodes.join(ends, trie.KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return digests.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return qualityrules.quality_rules(docs, qualityrules.fit_without_held_out(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_itq, op2_bpe, op3_lines, op4_quality, op5_tokens, op6_minhash, op7_fingerprint, op8_licenses, op9_mixing, op10_pii, op11_crosstok, op12_trie, op13_rules)}
#: CRC-32 is a fold over the digits with its table made by rule; a sequence of turns is a text with the lengths of what it joins.
TRIE_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS k),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, x: xor(k[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM t), tab),
sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
turns AS (
  SELECT v.c, pos, r, x FROM convs v JOIN t ON t.c = v.b WHERE pos <= h
  UNION ALL
  SELECT v.c, pos - h + least(h, coalesce(n, 0)), r, x FROM convs v JOIN t ON t.c = v.c LEFT JOIN sizes s ON s.c = v.b WHERE pos > h),
member AS (
  SELECT c, pos AS d, md5(string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos)) AS k, strlen(x) AS bytes FROM turns
  UNION ALL
  SELECT c, 0, 'root', 0 FROM convs),
node AS (SELECT k, min(d) AS d, min(c) AS c, count(*) AS n, min(bytes) AS bytes FROM member GROUP BY k),
parent AS (SELECT n.k, m.k AS up, p.c AS parent FROM node n JOIN member m ON m.c = n.c AND m.d = n.d - 1 JOIN node p ON p.k = m.k),
child AS (SELECT up AS k, count(*) AS n FROM parent GROUP BY up),
rolled AS (
  SELECT m.k, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.bytes) AS saved
  FROM node n LEFT JOIN child ch ON ch.k = n.k JOIN member m ON m.c = n.c AND m.d <= n.d GROUP BY m.k),
last AS (SELECT c, arg_max(k, d) AS k FROM member GROUP BY c),
ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e FROM last GROUP BY k)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, p.parent AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children, CAST(r.leaves AS BIGINT) AS n_leaves,
  CAST(r.saved AS BIGINT) AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
FROM node n JOIN rolled r ON r.k = n.k LEFT JOIN parent p ON p.k = n.k LEFT JOIN child ch ON ch.k = n.k LEFT JOIN ends e ON e.k = n.k
"""
ORACLE_SQL: dict[str, str] = {"op12_trie": TRIE_SQL}
