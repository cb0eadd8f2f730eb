"""Helpers that several operators share: shared-folder tables, checked broadcasts, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but ASCII space and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only when a count has shown it to be no longer than this.
BROADCAST_ROWS = 100_000
#: Rows of a short intermediate table that one task makes and writes.
TASK_ROWS = 50_000
#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a worker handles at a time; a longer text is handled alone.
SLICE = 1 << 20


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where the setting is missing, a session whose tasks all run in this process has a temporary folder; any other raises RuntimeError, since
    executors don't see each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _own_folders[app]


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Shuffle files of what is run within are deleted when it ends, rather than some time after the driver has forgotten them."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str, rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    It cuts the lineage in a way that survives the loss of executors, and is smaller than a
    checkpoint of rows. Where a bound of the number of rows is known, one task writes TASK_ROWS of them, so that short tables
    are not hundreds of files. codec is the compression of the files, if not the session's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        (df if rows is None else df.coalesce(rows // TASK_ROWS + 1)).write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads. A result's own plan reads the others, which stay with the folder."""
    for df in tables:
        path = getattr(df, "_cairn_path", None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into consecutive slices with at most SLICE bytes in the column of texts, one row at least.

    What a worker makes of a slice is given back before the next, so that its memory does not grow with Spark's batches.
    """
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(at, end - at)
            at = end


def let_go() -> None:
    """Give memory that this worker no longer uses back to the system, at the end of a task: workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows it to be short, else df for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: a row (node, root) for each node of an edge.

    root is the smallest node of the component. Large-star and small-star rounds; in each, a node's
    neighbours meet only in a minimum (combined before the shuffle) and in a join that the adaptive
    planner can split, so that a node with very many links is no bottleneck. Each round is
    written to the shared folder. Loops and edges with a null are dropped; no edges give no rows.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        step = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after_df = materialize(step, "edges", before[0])
        after = print_of(after_df)
        release(now)
        now = after_df
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
