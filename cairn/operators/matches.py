"""The best match of each set among many, by Jaccard similarity: equal sets by hash, the rest block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .similar import best_similar


def _set_key(grams: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), F.size(grams), grams).alias(name) for salt, name in ((5, "_s1"), (17, "_s2"))]


def best_match(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """For each row of left (id, *keys, grams, before) the most similar row of right (match_id, *keys, grams, at) of its keys: (id, match_id, similarity).

    As similar.best_similar: grams are sorted arrays of distinct longs, only similarities of `least` or more count, only rows with at < before (null: all), and no row with the id itself; of equally similar
    rows the one of least at, which is unique in its group. Rows without a match are left out. Null keys are keys.

    Equal sets are matched first, by a hash of 128 bits: nothing is more alike. Of a group of equal sets on the right the two of least at stand for all, however many there are (the second for
    a row that is the first itself). Only rows without an equal partner are compared with these heads, block by block.
    """
    key = F.struct(*keys).alias("_key")
    left = stored(left.where(F.size("grams") > 0).select("id", key, F.col("before").cast("long").alias("before"), "grams", *_set_key(F.col("grams"))), "left")
    right = stored(right.where(F.size("grams") > 0).select("match_id", key, F.col("at").cast("long").alias("at"), "grams", *_set_key(F.col("grams"))), "right")
    sets = ["_key", "_s1", "_s2"]
    first = right.groupBy(*sets).agg(F.min(F.struct("at", "match_id")).alias("x")).select(*sets, "x.*")
    others = right.select(*sets, "at", "match_id").join(first.select(*sets, F.col("at").alias("_at")), sets).where("at <> _at")
    second = others.groupBy(*sets).agg(F.min(F.struct("at", "match_id")).alias("x")).select(*sets, "x.*")
    heads = stored(first.unionByName(second), "heads")
    allowed = (F.col("id") != F.col("match_id")) & (F.col("before").isNull() | (F.col("at") < F.col("before")))
    equal = left.join(heads, sets).where(allowed).groupBy("id").agg(F.min(F.struct("at", "match_id")).alias("x"))
    equal = stored(equal.select("id", "x.match_id", F.lit(1.0).alias("similarity")), "equal")
    if least >= 1:
        return equal
    rest = left.join(equal, "id", "left_anti").select("id", F.col("_key").alias("group"), "grams", "before")
    kept = right.join(heads.select("_key", "match_id"), ["_key", "match_id"], "left_semi").select("match_id", F.col("_key").alias("group"), "grams", "at")
    return equal.unionByName(best_similar(rest, kept, ["group"], least))
