"""Quality rules: counts of a text, and a calibrated logistic regression on hashed word and character n-grams.

A text's features are the relative frequencies of its hashed n-grams, of words (one and two) and of code points (two to four). A score is so the
mean of the weights of its n-grams, which numpy takes over all texts of an Arrow batch at once. The model is fitted by Spark's
LogisticRegression on labelled rows, and its margins are turned into probabilities by a second one, on rows that were kept back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialize, release, slices
from .quality import held_out
from .shingles import _power_tables, chunks, mix64

#: Bits of the hashed feature space; lengths of runs of code points.
SPACE_BITS, CHARS = 18, (2, 3, 4)
#: Frequencies are multiplied by it, so that the penalty on weights suits them.
SCALE = 50.0
#: Labelled rows that a model is fitted on at most, those of smallest hash; one in so many of them calibrates it; tasks that hold them.
FIT_ROWS, CALIBRATE, FIT_TASKS = 8_000, 4, 4
PENALTY, STEPS = 1e-4, 40
#: Rules of the base: words at least, words of a window, percentage of words in repeated windows at most.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: A line has a word if anything is left when these are stripped.
GAPS = " \t\n\v\f\r"

_STEP = np.uint64(0xD6E8FEB86659FD93)
_AGAIN = np.uint64(0x5851F42D4C957F2D)
_SHIFT = np.uint64(64 - SPACE_BITS)


class Texts:
    """The code points and words of some texts, joined, with the bounds of each text within them."""

    def __init__(self, texts: list[str]):
        self.bounds = np.cumsum([0] + [len(t) for t in texts])
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.gap = (self.points == 32) | ((self.points >= 9) & (self.points <= 13))
        # A word begins where a text does or after a gap, and ends likewise.
        inside, edge = ~self.gap, np.zeros(len(self.points) + 1, bool)
        edge[self.bounds] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        up, down = _power_tables(len(self.points) + 1)
        sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum((self.points + np.uint64(1)) * up[: len(self.points)], out=sums[1:])
        self.words = mix64((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.word_bounds = np.searchsorted(self.starts, self.bounds)

    def grams(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, indices, first, last) of the n-grams of each length: those of text k stand from first[k] to last[k] of the indices.

        A word like the one before it counts as a sign of its own in pairs, so that repetition of any word is one feature.
        """
        out = []
        words, a, b = self.words, self.word_bounds[:-1], self.word_bounds[1:]
        out.append((0, mix64(words ^ np.uint64(1)) >> _SHIFT, a, b))
        follow = np.where(words[1:] == words[:-1], _AGAIN, words[1:])
        out.append((0, mix64(words[:-1] * _STEP + follow + np.uint64(2)) >> _SHIFT, a, np.maximum(a, b - 1)))
        a, b = self.bounds[:-1], self.bounds[1:]
        for n in CHARS:
            h = np.full(max(0, len(self.points) - n + 1), n, np.uint64)
            for k in range(n):
                h = h * _STEP + self.points[k : k + len(h)]
            out.append((1, mix64(h) >> _SHIFT, a, np.maximum(a, b - n + 1)))
        return out

    def margins(self, weights: np.ndarray, intercept: float) -> np.ndarray:
        """The margin of each text: the intercept and, of either kind, the mean weight of its n-grams times SCALE."""
        n = len(self.bounds) - 1
        sums, counts = np.zeros((2, n)), np.zeros((2, n))
        for kind, index, first, last in self.grams():
            some = last > first
            pairs = np.stack((first[some], last[some]), 1).ravel()
            # An even place sums up to the odd one after it; the zero at the end lets a range end with the array.
            sums[kind, some] += np.add.reduceat(np.append(weights[index], 0.0), pairs)[::2] if len(pairs) else 0
            counts[kind] += last - first
        return intercept + SCALE * (sums / np.maximum(counts, 1)).sum(axis=0)

    def features(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices, in order, and values of one text."""
        found: list[list[np.ndarray]] = [[], []]
        for kind, index, first, last in self.grams():
            found[kind].append(index[first[k] : last[k]])
        index = np.concatenate([x for kind in found for x in kind])
        share = np.concatenate([np.full(len(x), SCALE / max(1, sum(map(len, kind)))) for kind in found for x in kind])
        used, back = np.unique(index, return_inverse=True)
        return used.astype(np.int32), np.bincount(back, weights=share, minlength=len(used))

    def repeated(self) -> np.ndarray:
        """How many words of each text stand in a run of WINDOW words that the text has twice or more."""
        n, first, last = len(self.words), self.word_bounds[:-1], self.word_bounds[1:]
        runs = np.zeros(max(0, n - WINDOW + 1), np.uint64)
        for k in range(WINDOW):
            runs = runs * _STEP + self.words[k : k + len(runs)]
        owner = np.repeat(np.arange(len(first)), last - first)
        whole = owner[: len(runs)] == owner[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        # The owner is part of the hash, so that runs of different texts differ.
        key = mix64(runs[at] ^ mix64(owner[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(at) else False
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        return inside[last] - inside[first]

    def counts(self) -> list[np.ndarray]:
        """Words, code points in words and symbols of each text."""
        total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[self.bounds])
        return [np.diff(self.word_bounds), total(~self.gap), total(np.isin(self.points, np.array([ord(c) for c in SYMBOLS], np.uint64)))]


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    return len(lines) - len(set(lines))


@dataclass
class Model:
    """Weights of n-grams, and the line from a margin to the calibrated margin."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of label_col, which is 0 or 1, from FIT_ROWS labelled rows at most. Only the text is a feature.

    Rows with a null label or id are not learned from; of rows with one id the first text counts. With labels of one kind only, or none, every
    text has the smoothed share of label 1. One in CALIBRATE rows, by hash, is kept back from the weights and calibrates them.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("id", "label"), "id", "label").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))

    @F.udf(VectorUDT())  # a bounded number of rows
    def vector(text: str) -> SparseVector:
        return SparseVector(1 << SPACE_BITS, *Texts([text]).features(0))

    h = F.xxhash64("id", "label")
    made = rows.select(h.alias("h"), F.col("label").cast("double").alias("label"), vector("text").alias("features"))
    made = materialize(made.repartition(FIT_TASKS, "h").sortWithinPartitions("h"), "quality-rules")
    held = made.coalesce(FIT_TASKS)  # gradients of so few tasks are added up without a shuffle
    back = F.pmod(F.col("h"), F.lit(CALIBRATE)) == 0
    found = {(r["back"], r["label"]): r["n"] for r in made.groupBy(back.alias("back"), "label").agg(F.count("*").alias("n")).collect()}
    kinds = lambda side: {label for b, label in found if b is side}
    if kinds(False) != {0.0, 1.0}:
        ones, n = sum(c for (_, label), c in found.items() if label == 1), sum(found.values())
        release(made)
        return Model(np.zeros(1 << SPACE_BITS), float(np.log((ones + 1) / (n - ones + 1))), 1.0, 0.0)
    model = LogisticRegression(regParam=PENALTY, maxIter=STEPS, standardization=False).fit(held.where(~back))
    weights, intercept, slope, offset = model.coefficients.toArray(), float(model.intercept), 1.0, 0.0
    if kinds(True) == {0.0, 1.0}:
        margin = model.transform(held.where(back)).select("label", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"))
        line = LogisticRegression(regParam=1e-3, maxIter=STEPS, standardization=False).fit(margin)
        slope, offset = float(line.coefficients[0]), float(line.intercept)
    release(made)
    return Model(weights, intercept, slope, offset)


def quality_rules(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept) for each row of docs.

    A text fails the base with fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in repeated runs of WINDOW words. Others are
    kept if the calibrated probability of label 1 reaches the threshold. Null texts count as empty, and fail. Ids may be null or repeat: rows are handled
    one by one, whole. Other columns are ignored, whatever their names. No rows give no rows.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), Model(np.zeros(0), model.intercept, model.slope, model.offset)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, line = held.value
        weights = weights.astype(np.float64)
        for batch in slices(batches, "text"):
            whole = batch.column("text").to_pylist()
            for part in chunks([len(t) for t in whole]):
                texts = whole[part]
                t = Texts(texts)
                numbers = [*t.counts(), np.array([repeated_lines(x) for x in texts]), t.repeated()]
                p = line.probabilities(t.margins(weights, line.intercept))
                ids = batch.column("id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(n.astype(np.int64)) for n in numbers), pa.array(p)], ["id", *names, "probability"])
        let_go()

    out = frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, {', '.join(n + ' long' for n in names)}, probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), *names, failed.alias("base_failed"), "probability", (~failed & (F.col("probability") >= threshold)).alias("kept"))


def fit_without_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """fit, without the labels that quality.held_out keeps back."""
    return fit(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
