"""Character grams of whole texts as numbers: exact, and made in Arrow batches, since a lambda for each place of a long text is too slow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a code point; grams of up to three characters fit a long.
_BITS = 21


def _places(text: str | None, n: int) -> np.ndarray:
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(points) - n + 1, np.int64)
    for k in range(n):
        out = out << _BITS | points[k : k + len(out)]
    return out


def _sets(texts: pa.Array, n: int) -> pa.Array:
    found = [np.unique(_places(t.as_py(), n)) for t in texts]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(found) if found else np.zeros(0, np.int64))


@F.arrow_udf(T.ArrayType(T.LongType()))
def bigrams(texts: pa.Array) -> pa.Array:
    """The distinct runs of two characters, sorted; none of a shorter or null text."""
    return _sets(texts, 2)


@F.arrow_udf(T.ArrayType(T.LongType()))
def trigrams(texts: pa.Array) -> pa.Array:
    """The distinct runs of three characters, sorted; none of a shorter or null text."""
    return _sets(texts, 3)


@F.arrow_udf(T.DoubleType())
def multiset_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """The runs of two characters that both texts have, each as often as in both, by those of either as often as in one. Null where neither has any."""
    out = []
    for x, y in zip(a, b):
        (g, n), (h, m) = (np.unique(_places(t.as_py(), 2), return_counts=True) for t in (x, y))
        _, i, j = np.intersect1d(g, h, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[i], m[j]).sum())
        either = int(n.sum() + m.sum()) - both
        out.append(both / either if either else None)
    return pa.array(out, pa.float64())
