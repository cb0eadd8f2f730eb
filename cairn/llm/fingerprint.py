"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch holds every distinct shingle hash below a fixed fraction of the hash range. So the sketch of a union is the union of
sketches below the smaller fraction, and the share of one sketch found in another estimates containment whatever the
sizes of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands between words: ASCII space and the five ASCII controls.
GAP = r"[\x20\x09-\x0D]+"

#: One in so many shingle hashes is kept.
SCALE = 4
#: Ranges of ids in which neighbours are found apart from other ranges. Their edges, and a row for each, are all that is broadcast.
RANGES = 8_192


def bound(value: Column, use) -> Column:
    """use(value), with value computed once per row: inside a lambda of its own a plain expression is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """The hashes of all runs of so many words of a lower-cased text; of fewer words one of all; of none or null none."""
    hashes = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - words), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(words)]))
    fewer = lambda ws: F.when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))
    return bound(hashes, lambda ws: F.when(F.size(ws) < words, fewer(ws)).otherwise(runs(ws)))


def sketch(text: Column, words: int = 5, scale: int = SCALE) -> Column:
    """The sorted distinct shingle hashes of a text below the fraction 1 / scale of the range of 64-bit numbers.

    Where there are shingles but none is below, as in short texts, the smallest hash stands for them, so that different short texts differ.
    """
    below = -(1 << 63) + (1 << 64) // scale
    kept = lambda hs: F.sort_array(F.array_distinct(F.filter(hs, lambda h: h < below)))
    least = lambda hs: F.when(F.size(hs) > 0, F.array(F.array_min(hs))).otherwise(F.array().cast("array<bigint>"))
    return bound(shingle_hashes(text, words), lambda hs: F.get(F.transform(F.array(kept(hs)), lambda k: F.when(F.size(k) > 0, k).otherwise(least(hs))), F.lit(0)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together: the union below the fraction, or else the smaller stand-in."""
    below = -(1 << 63) + (1 << 64) // scale
    return bound(F.sort_array(F.array_union(a, b)), lambda u: F.when(F.get(u, F.lit(0)) < below, F.filter(u, lambda h: h < below)).otherwise(F.slice(u, 1, 1)))


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has, as their sketches tell; null where a's sketch is empty."""
    return F.size(F.array_intersect(a, b)) / F.when(F.size(a) > 0, F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two sketches tell, 0 to 1. Two empty sketches are alike, 1; one empty one is unlike any other, 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(1.0))


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(rows: DataFrame, id_col: str, carry: list[str], tie: str, derive: dict[str, Column]) -> DataFrame:
    """rows with a column more, next: a struct of carry from the following row by descending id, nulls last, then tie; after the last the first.

    Ids are cut into RANGES ranges by quantiles. A range is ordered apart from the others; the row that
    opens it is also given to the range before, as its last. derive has columns that are computed where the rows
    of a range have met, so that they are not moved; carry may name them.
    """
    quantiles = [k / RANGES for k in range(1, RANGES)]
    edges = rows.agg(F.percentile_approx(id_col, quantiles, 10 * RANGES).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    where = F.coalesce(F.lit(-1) * _place(F.col(id_col), edges), F.lit(1))  # rises as ids fall; nulls last
    placed = rows.withColumn("_range", where)
    opens = placed.groupBy("_range").agg(F.max(id_col).alias("_top"))
    order = Window.orderBy("_range")
    last = F.max("_range").over(Window.partitionBy())
    opens = opens.select(F.col("_range").alias("_r"), "_top", F.coalesce(F.lag("_range").over(order), last).alias("_before"))  # RANGES + 1 rows at most
    joined = placed.join(F.broadcast(opens), (F.col("_range") == F.col("_r")) & F.col(id_col).eqNullSafe(F.col("_top")), "left")
    copies = F.array(F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost")), F.when(F.col("_r").isNotNull(), F.struct(F.col("_before").alias("at"), F.lit(1).alias("ghost"))))
    dealt = joined.withColumn("_c", F.explode(F.array_compact(copies))).select(*rows.columns, "_c.at", "_c.ghost")
    dealt = dealt.repartition("at").withColumns(derive)
    window = Window.partitionBy("at").orderBy("ghost", F.col(id_col).desc_nulls_last(), tie)
    return dealt.withColumn("next", F.lead(F.struct(*carry)).over(window)).where("ghost = 0").drop("at", "ghost")


def _place(value: Column, edges: list) -> Column:
    """How many of the sorted edges are at most value, by binary search; null for null."""
    table = F.lit(edges) if edges else F.array(F.lit(None).cast("bigint"))
    steps = F.lit([1 << k for k in reversed(range(len(edges).bit_length() + 1))])
    below = lambda at, step: F.coalesce(F.get(table, at + step - 1) <= value, F.lit(False))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))
    return F.when(value.isNotNull(), found)


def edited_fingerprints(docs: DataFrame, words: int = 5, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of each text and of its edited text, and likenesses: a row per row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the text of the next
    row by descending id (after the last the first; the only row follows itself). Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex of the sketches),
    near_edited, near_next (Jaccard likeness), part_edited (the share of the text's shingles that the edited text has).

    A null text is the empty text. Texts without a word have the empty fingerprint; two of
    these are alike, 1. Null ids come last, equal ids in the order of the texts' hash, rows equal in both in
    any. Other columns are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("tie"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next.text", F.lit(1), half))
    rows = with_next(rows, "id", ["text", "own"], "tie", {"own": sketch(F.col("text"), words, scale)}).select("id", F.char_length("text").cast("long").alias("n_chars"), "own", F.col("next.own").alias("following"), edited.alias("edited"))
    rows = rows.withColumn("changed", sketch(F.col("edited"), words, scale))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), containment(F.col("own"), F.col("changed")).alias("part_edited"),
    )
