"""Turns read as they come, and stored so that a batch that is run twice changes nothing.

The stream's checkpoint is the cursor: what a batch has read is not read again. A batch writes one directory of its own number, which a second run of the batch overwrites; the
store is what all directories together say of each turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import store_turns

#: Fixed values of the message source: roles that are read, the least length, and the length that is kept.
ROLES, LEAST, MOST = ("user", "assistant"), 10, 2_000
#: What a stored turn is known by.
KEY = ["user_id", "session_id", "content_hash"]


def readable(turns: DataFrame) -> DataFrame:
    """Turns that the message source gives: those of its roles and of more than LEAST characters, cut at MOST."""
    return turns.where(F.col("role").isin(*ROLES) & (F.length("content") > LEAST)).withColumn("content", F.substring("content", 1, MOST))


def writer(path: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch runs: the batch's turns by user, session and content, in the directory of the batch."""

    def write(batch: DataFrame, number: int) -> None:
        store_turns(readable(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def held(spark: SparkSession, path: str) -> DataFrame:
    """The store: (user_id, session_id, content_hash, first_turn, occurrences, first_s, last_s), over all batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*KEY).agg(F.min("first_turn").alias("first_turn"), F.sum("occurrences").alias("occurrences"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"))


def follow(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store a stream of turns (user_id, session_id, turn, role, ts_s, content) up to what is there now, from where the checkpoint ends."""
    return turns.writeStream.foreachBatch(writer(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
