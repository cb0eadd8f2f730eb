"""The corpus pipeline: documents in, a mixed and tokenised corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, lines, minhash, mixing, quality
from cairn.llm.common import materialize, release
from cairn.llm.queries import MIX_WEIGHTS, RANKS, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"), threshold=0.3)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go, and documents of nothing else; n_chars counts what stays."""
    return with_length(lines.remove_lines(docs.select(COLUMNS), percent=80))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.keep_one(docs.select(COLUMNS), percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as the mix takes them; rows that it takes no copy of go."""
    return mixing.emit(docs.select(COLUMNS), mixing.mix(docs, MIX_WEIGHTS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row: (doc_id, ids, n_tokens)."""
    return bpe.bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("mix", mix_stage), ("bpe", bpe_stage)]
#: SQL can't express the classifier and the merges: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            release(before)
    return docs
