"""The most similar row of each row's group, by Jaccard similarity of sets of grams, for groups of any size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; each pair of blocks of a group is a task's work. Rows of a block that are compared at once, and grams that are multiplied at a time.
BLOCK, PART, WIDTH = 4_096, 512, 4_096
#: Sets that rows of a block are measured against, and the rows from which they are made.
PIVOTS, SAMPLE = 8, 512
#: Rows of a part are at like distances from their pivot, in steps of so much.
RING = 0.15

_FOUND = pa.schema([("id", pa.int64()), ("match_id", pa.int64()), ("at", pa.int64()), ("similarity", pa.float64())])


class _Sets:
    """Sets of grams, numbered from 0, one behind the other."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes, self.ends = values, sizes, np.concatenate([[0], np.cumsum(sizes)])

    def take(self, rows: np.ndarray) -> _Sets:
        sizes = self.sizes[rows]
        at = np.repeat(self.ends[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return _Sets(self.values[at], sizes)

    def part(self, start: int, end: int) -> _Sets:
        return _Sets(self.values[self.ends[start] : self.ends[end]], self.sizes[start:end])

    def dense(self, place: np.ndarray, width: int) -> np.ndarray:
        """A 0/1 matrix of the grams that have a place."""
        out, at = np.zeros((len(self.sizes), width), np.float32), place[self.values]
        hit = at >= 0
        out[np.repeat(np.arange(len(self.sizes)), self.sizes)[hit], at[hit]] = 1
        return out


def _numbered(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[_Sets, _Sets, int]:
    columns = [c.combine_chunks() for c in (left, right)]
    flat = [c.flatten() for c in columns]
    codes = pa.concat_arrays(flat).dictionary_encode()
    values, cut = codes.indices.to_numpy(), len(flat[0])
    a, b = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in columns)
    return _Sets(values[:cut], a), _Sets(values[cut:], b), len(codes.dictionary)


def _distances(sets: _Sets, pivots: np.ndarray) -> np.ndarray:
    """Jaccard distances of sets without an empty one from the columns of a 0/1 matrix of grams and pivots."""
    both = np.add.reduceat(pivots[sets.values], sets.ends[:-1], axis=0).astype(np.float64)
    return 1 - both / (sets.sizes[:, None] + pivots.sum(axis=0, dtype=np.float64)[None, :] - both)


def _pivots(sets: _Sets, names: int) -> np.ndarray:
    """Sets as far apart as rows are, each the grams that half of the rows nearest to it have: a 0/1 matrix of grams and pivots."""
    rows = sets.take(np.unique(np.linspace(0, len(sets.sizes) - 1, SAMPLE).astype(int)))
    out, apart = np.zeros((names, 0), np.float32), None
    for _ in range(PIVOTS):
        far = 0 if apart is None else int(apart.argmax())
        if apart is not None and apart[far] <= 0:
            break
        one = np.zeros((names, 1), np.float32)
        one[rows.part(far, far + 1).values] = 1
        out = np.hstack([out, one])
        d = _distances(rows, one)[:, 0]
        apart = d if apart is None else np.minimum(apart, d)
    nearest = _distances(rows, out).argmin(axis=1)
    for k in range(out.shape[1]):
        own = rows.take(np.flatnonzero(nearest == k))
        out[:, k] = 2 * np.bincount(own.values, minlength=names) >= max(len(own.sizes), 1)
    return out


def _overlaps(left: _Sets, right: _Sets, names: int) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the grams of both."""
    out = np.zeros((len(left.sizes), len(right.sizes)), np.float32)
    known = np.flatnonzero((np.bincount(left.values, minlength=names) > 0) & (np.bincount(right.values, minlength=names) > 0))
    for at in range(0, len(known), WIDTH):
        part, place = known[at : at + WIDTH], np.full(names, -1)
        place[part] = np.arange(len(part))
        out += left.dense(place, len(part)) @ right.dense(place, len(part)).T
    return out.astype(np.float64)


def _best(left: pa.Table, right: pa.Table, least: float, part: int = PART) -> pa.Table:
    """For each row of left its best row of right, of equal ones that of least at; rows without one are left out.

    A row meets only parts of right that can hold a row as similar as the best so far: by sizes, and by the triangle inequality of Jaccard distances from a few
    sets (pivots). Parts have rows of like sizes near one pivot. The bounds leave out no row that could be the best, so that the result is that of all pairs.
    """
    if not left.num_rows or not right.num_rows:
        return _FOUND.empty_table()
    a, b, names = _numbered(left.column("grams"), right.column("grams"))
    pivots = _pivots(b, names)
    sides = []
    for sets in (a, b):
        d = _distances(sets, pivots)
        ring = d.argmin(axis=1) * 10 + np.floor(d.min(axis=1) / RING).astype(int)
        order = np.lexsort((sets.sizes, ring))
        sides.append((sets.take(order), d[order], ring[order], order))
    (a, da, _, order_a), (b, db, ring, order_b) = sides
    ids, matches, at = left.column("id").to_numpy()[order_a], right.column("match_id").to_numpy()[order_b], right.column("at").to_numpy()[order_b]
    limit = pc.fill_null(left.column("before"), np.iinfo(np.int64).max).to_numpy()[order_a]
    edges = np.union1d(np.flatnonzero(np.diff(ring)) + 1, [0, len(ring)])
    cuts = [(s, min(s + part, e)) for f, e in zip(edges[:-1], edges[1:]) for s in range(f, e, part)]
    most = np.ones((a.sizes.size, len(cuts)))  # of each row's similarity to a row of each part
    for k, (s, e) in enumerate(cuts):
        low, high = b.sizes[s:e].min(), b.sizes[s:e].max()
        apart = np.maximum(da - db[s:e].max(axis=0), db[s:e].min(axis=0) - da).max(axis=1)
        most[:, k] = np.minimum.reduce([np.ones(len(da)), a.sizes / low, high / a.sizes, 1 - apart]) + 1e-9
    best, best_at, best_row = np.full(len(ids), float(least)), np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
    for start in range(0, len(ids), part):
        end = min(start + part, len(ids))
        for k in np.argsort(-most[start:end].mean(axis=0), kind="stable"):
            rows = start + np.flatnonzero(most[start:end, k] >= best[start:end])
            if not len(rows):
                continue
            s, e = cuts[k]
            both = _overlaps(a.take(rows), b.part(s, e), names)
            similarity = both / (a.sizes[rows, None] + b.sizes[None, s:e] - both)
            similarity[(ids[rows, None] == matches[None, s:e]) | (at[None, s:e] >= limit[rows, None])] = -1.0
            top = similarity.max(axis=1)
            first = np.where(similarity == top[:, None], at[None, s:e], np.iinfo(np.int64).max).argmin(axis=1)
            better = (top > best[rows]) | ((top == best[rows]) & (at[s:e][first] < best_at[rows]))
            rows, first = rows[better], first[better]
            best[rows], best_at[rows], best_row[rows] = top[better], at[s:e][first], s + first
    keep = np.flatnonzero(best_row >= 0)
    return pa.Table.from_arrays([pa.array(ids[keep]), pa.array(matches[best_row[keep]]), pa.array(best_at[keep]), pa.array(best[keep])], schema=_FOUND)


def best_similar(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """For each row of left (id, *keys, grams, before) the most similar row of right (match_id, *keys, grams, at) of its keys: (id, match_id, similarity).

    grams are arrays of longs. Only similarities of `least`, above 0, or more count, only rows with at < before (null: all), and no row with the
    id itself; of equally similar rows the one of least at, which should be unique in its group. Rows without a match are left out. Null keys are keys.

    Sets whose sizes differ too much for `least` never meet: groups are cut by classes of size. What is left is cut into hashed blocks, and pairs of
    blocks are compared at once, so that no task holds a group and only the best of each part of a block is written.
    """
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # apart, for both may come from one table
    step = -math.log(least) + 1e-9
    sized = lambda df: df.where(F.size("grams") > 0).select(F.struct(*keys).alias("key"), "*", F.floor(F.log(F.size("grams").cast("double")) / step).alias("class"))
    counted = lambda df, n: df.groupBy("key", "class").agg(F.ceil(F.count("*") / BLOCK).alias(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    near = [F.lit(-1), F.lit(0), F.lit(1)] if least < 1 else [F.lit(0)]
    l = sized(left).withColumn("class", F.explode(F.transform(F.array(*near), lambda d: F.col("class") + d)))
    r = sized(right)
    blocks = counted(l, "n").join(counted(r, "m"), ["key", "class"])
    l = l.join(blocks, ["key", "class"]).select("key", "class", "id", "grams", F.col("before").cast("long").alias("before"), F.pmod(F.xxhash64("id"), F.col("n")).alias("i"), every("m").alias("j"))
    r = r.join(blocks, ["key", "class"]).select("key", "class", "match_id", "grams", F.col("at").cast("long").alias("at"), F.pmod(F.xxhash64("match_id"), F.col("m")).alias("j"), every("n").alias("i"))
    group = ["key", "class", "i", "j"]
    found = l.groupBy(*group).cogroup(r.groupBy(*group)).applyInArrow(lambda a, b: _best(a, b, least), "id long, match_id long, at long, similarity double")
    best = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("at")).alias("o"), "match_id")).alias("x"))
    return best.select("id", "x.match_id", "x.similarity")
