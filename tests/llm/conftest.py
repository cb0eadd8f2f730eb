import pytest
from pyspark.sql import types as T

#: doc_id, text, lang, source, n_chars as in documents, with columns more whose names operators use themselves.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("id", "th", "cls", "size", "key", "score", "component_id", "copies", "spans", "n_tokens")]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text[, source]), with nulls and clashing columns."""

    def make(*rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, *["x"] * 10) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


WORDS = [f"w{k}x" for k in range(4000)]


def prose(start: int, count: int) -> str:
    return " ".join(WORDS[(start * 37 + k * k + 7 * k) % 4000] for k in range(count))


#: Nulls, empties, ties, repeated rows, a very long text, and texts without words.
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, prose(1, 30)), (6, prose(1, 30)), (7, prose(2, 6000)), (8, "a b\n\nc d\n"), (None, None), (9, "\u00e9\u4e2d\U0001f600 x")]
