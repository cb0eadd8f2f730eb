"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session whose tasks all run in this process may do without, and has a temporary one; any other raises RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _own[context.applicationId]


def stored(df: DataFrame, label: str, partition: list[str] | None = None) -> DataFrame:
    """df written as Parquet into the shared folder, by directories of the partition columns if there are any, and read again: what lost executors had made is not made anew."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write if partition is None else df.write.partitionBy(*partition)
    writer.parquet(path)
    order = [c for c in df.columns if c not in (partition or [])] + (partition or [])
    out = df.sparkSession.read.schema(df.select(*order).schema).parquet(path)
    out._stored = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of a key in one partition, for Python that folds them.

    Dealt by a hash of the keys: a plain repartition by the keys of a join below is left out of the plan, and where that join
    becomes a broadcast its own shuffle is read by mappers, so that a key is in several tasks.
    """
    return df.repartition(F.xxhash64(*keys))


def shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle. For tables that grow with the input: Spark would send each that takes little disk through the driver, and packed tables are many times as large there."""
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_stored", None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
