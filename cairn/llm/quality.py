"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL, scored as sparse dot products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, slices

#: Bits of the hashed feature space; words in an n-gram at most.
SPACE_BITS, GRAMS = 20, 2
#: Labelled rows that a model is fitted on at most, those of smallest hash; rounds over them.
FIT_ROWS, ROUNDS = 8_000, 8

#: A word is a run of letters, of digits, or of one other sign that is no space.
WORDS = regex.compile(r"\p{L}+|\p{N}+|([^\s\p{L}\p{N}])\1*").finditer
_MULTIPLIER = 0x9E3779B97F4A7C15


def _shape(word: str) -> str:
    """What a rare word is known by: its case and length class, digits, or the sign itself."""
    if word[0].isalpha():
        case = "a" if word.islower() else "A" if word.isupper() and len(word) > 1 else "Aa" if word.istitle() else "aA"
        return f"{case}{min(len(word), 24) // 4}"
    return "0" if word[0].isnumeric() else word[:4]


class Words(dict):
    """Two numbers for each word: of the word and of its shape. A bounded memo, cleared by its user."""

    def __missing__(self, word: str) -> tuple[int, int]:
        value = (_stable(word), _stable("\0" + _shape(word)))
        if len(word) <= 64:
            self[word] = value
        return value


def _stable(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


_words = Words()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text: hashed n-grams of words and of word shapes, with log counts, of length 1.

    A word like the one before it is written as a sign of its own in n-grams of two or more, so that repetition of any
    word is one feature. The empty text has only the constant feature, index 0.
    """
    if len(_words) > 1 << 16:
        _words.clear()
    pairs = [_words[m.group()] for m in WORDS(text)]
    if not pairs:
        return np.zeros(1, np.int64), np.ones(1)
    word, shape = np.array(pairs, np.uint64).T
    shift = np.uint64(64 - SPACE_BITS)
    grams = []
    for kind, base in ((1, word), (2, shape)):
        again = np.concatenate(([False], word[1:] == word[:-1]))
        run = base
        for n in range(1, GRAMS + 1 + (kind == 2)):
            if n > 1:
                follow = np.where(again, np.uint64(0x5851F42D4C957F2D), base)[n - 1 :]
                run = run[: len(follow)] * np.uint64(0xD6E8FEB86659FD93) + follow
            grams.append(((run ^ np.uint64(kind * 16 + n)) * np.uint64(_MULTIPLIER)) >> shift)
    index, count = np.unique(np.concatenate(grams), return_counts=True)
    value = 1 + np.log(count)
    value /= math.sqrt(float(value @ value))
    return np.concatenate(([0], index.astype(np.int64))), np.concatenate(([1.0], value))


class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss, with sparse weights by L1."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.2, l2: float = 0.2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << SPACE_BITS), np.zeros(1 << SPACE_BITS)

    def weights(self, index) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (probability(float(w @ value)) - label) * value
        step = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - step * w
        self.n[index] += g * g


def probability(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The weights, 2**SPACE_BITS doubles, of a model of label_col, from FIT_ROWS labelled rows at most.

    Features are made in all tasks; one task then takes the updates, which follow one another, over this bounded
    sample in the order of a hash. Rows with a null label or id are not learned from. Without rows all weights are 0. Only the text is a feature.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("id", "label"), "id", "label").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # of rows with one id the first text

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [features(t.as_py()) for t in batch.column("text")]
            index, value = pa.array([x[0] for x in made], pa.list_(pa.int64())), pa.array([x[1] for x in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), index, value], ["h", "label", "index", "value"])
        _words.clear()
        let_go()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [x for b in batches for x in zip(b.column("label").to_pylist(), b.column("index"), b.column("value"))]
        seen = [(label, index.values.to_numpy(), value.values.to_numpy()) for label, index, value in seen]
        model = FTRL()
        for _ in range(ROUNDS):
            for label, index, value in seen:
                model.learn(index, value, label)
        weights = model.weights(slice(None))
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used])], ["index", "weight"])
        del seen, model
        let_go()

    made = rows.select(F.xxhash64("id", "label").alias("h"), "label", "text").mapInArrow(make, "h long, label int, index array<long>, value array<double>")
    table = made.repartition(1).sortWithinPartitions("h", "label", "index").mapInArrow(train, "index long, weight double").toArrow()  # 2**SPACE_BITS rows at most
    weights = np.zeros(1 << SPACE_BITS)
    weights[table.column("index").to_numpy()] = table.column("weight").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: Column) -> Column:
    """The probability that whole texts have label 1, as a column of docs; a null text is scored as the empty one. Only texts go through Python."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = held.value
        for batch in batches:
            scores = []
            for one in batch:
                index, value = features(one.as_py() or "")
                scores.append(probability(float(w[index] @ value)))
            yield pa.array(scores, pa.float64())
        _words.clear()
        let_go()

    return run(text)


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is kept back from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) for each row of docs, by a model that never sees held-out labels.

    Null and empty texts are scored too. Ids may be null or repeat. Other columns are ignored. No rows give no rows.
    """
    weights = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), score(docs, weights, F.col(text_col)).alias("score"))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs without the rows that score below the threshold, by the model of quality_scores. Columns stay as they are, whatever their names."""
    weights = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    scored = docs.select(F.struct("*").alias("row"), score(docs, weights, F.col(text_col)).alias("score"))
    return scored.where(F.col("score") >= threshold).select("row.*")
