"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small

#: Classes of size within a factor of 2**(1/8), and hashed slices of a class: the runs of a source that are summed apart.
CLASSES_PER_DOUBLING, SLICES = 8, 64
#: Random offsets are multiples of 2**-20, exact in sums with whole numbers.
STEPS = 1 << 20


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """A row per source: (source, source_size, target).

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating. Together they
    should give share times all sizes. A target stops at most times its source's size and what is
    over goes to the others by weight, until none is above: with the sources in order of size by
    weight, those that stop are a prefix, so that running sums over this short table give the level. A source
    of size 0 has target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    per = per.withColumn("level", left / weight).withColumn("at", F.row_number().over(by))
    goes_on = F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("at"))
    first = F.coalesce(F.min(goes_on).over(everything), F.lit(1 << 62))
    level = F.min_by("level", goes_on).over(everything)
    return per.select("source", "source_size", F.when(F.col("at") < first, F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of each row in the mix: (id_col, th, source, size, source_size, target, copies, taken), a row per row; th is xxhash64 of the text.

    A source's expected copies of each of its rows are target / source_size. The rows of a source stand in order of
    size class, hashed slice, size and id; the running sum of their expected copies plus one offset per source
    (hashed from seed and source) crosses whole numbers, and each crossing is a copy. Order by size makes the taken words come near
    the target. All expected copies of a source are alike, so that the running sum is a rank times a
    ratio: it has no rounding that depends on the order of additions, and reruns agree.

    A source is cut into classes and slices that are ranked apart, then shifted by the sums of those before, so that
    a source with most rows is no bottleneck. Null text has size 0, null source is a source,
    null ids and repeated rows are rows like any other (equal rows share their copies in any order). Rows
    of size 0 have copies that take 0 words. Other columns of docs are ignored. No rows give no rows.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(sizes, "sizes")
    targets = source_targets(sizes, weights, share, most)
    run = [
        F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * CLASSES_PER_DOUBLING).alias("class"),
        F.pmod(F.xxhash64("id", "size"), F.lit(SLICES)).alias("slice"),
    ]
    rows = sizes.select("id", "th", "source", "size", *run)
    runs = rows.groupBy("source", "class", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source", "class", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    runs = runs.join(small(targets), runs.source.eqNullSafe(targets.source)).select(runs.source, "class", "slice", "before", "source_size", "target")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "class", "slice").orderBy("size", "id", "th")))
    joined = ranked.alias("r").join(
        runs.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.class") == F.col("q.class")) & (F.col("r.slice") == F.col("q.slice"))
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64("r.source", F.lit(seed)), F.lit(STEPS)) / float(STEPS)
    end = F.col("before") + F.col("rank")
    copies = (F.floor(offset + ratio * end) - F.floor(offset + ratio * (end - 1))).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "th", F.col("r.source").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as many times as mixed, mix() of the same docs, says; rows with 0 copies go. Columns stay as they are, whatever their names.

    Rows meet by id, null ids too, and text; of rows equal in both, row k of the one side meets row k of the other, in any order.
    """
    key = F.coalesce(F.concat(F.lit("id"), F.col(id_col).cast("string")), F.lit("none"))
    number = F.row_number().over(Window.partitionBy("key", "th").orderBy(F.lit(1)))
    left = docs.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(text_col).alias("th")).withColumn("number", number)
    right = mixed.select(key.alias("key"), "th", "copies").withColumn("number", number)
    joined = left.join(right.where("copies > 0"), ["key", "th", "number"])
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
