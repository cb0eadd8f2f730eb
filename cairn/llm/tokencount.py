"""Token counts of fields and sections: a document is encoded once, whole, and its tokens are allocated by their character spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import codec, rank_bytes
from .common import let_go, slices

#: How a token that crosses a boundary is allocated: to the section of its first character; to that with most of its characters, the
#: first of several; or to each by its share of the token's characters.
RULES = ("start", "majority", "share")


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of tokens of these lengths in bytes that follow one another over a text.

    A token that begins within a character's bytes starts at that character; one that ends within ends after it.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode(), np.uint8)
    upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters that begin before each byte
    begins = np.concatenate(((data & 0xC0) != 0x80, [True]))
    return np.where(begins[starts], upto[starts], upto[starts] - 1), upto[ends]


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and the number of tokens that cross a boundary.

    Sections are [edges[k], edges[k+1]) and cover the text in order; empty ones get nothing. Both tokens and sections are sorted, so that
    two binary searches per token join their intervals.
    """
    n = len(edges) - 1
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends - 1, "right") - 1
    cross = np.flatnonzero(last > first)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(np.float64), len(cross)
    out = np.bincount(np.delete(first, cross), minlength=n).astype(np.float64)
    for k in cross.tolist():
        sections = np.arange(first[k], last[k] + 1)
        chars = np.minimum(edges[sections + 1], ends[k]) - np.maximum(edges[sections], starts[k])
        if rule == "majority":
            out[sections[np.argmax(chars)]] += 1
        else:
            out[sections] += chars / chars.sum()
    return out, len(cross)


def count_by_section(docs: DataFrame, lengths: Column, rank_path: str, pattern: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_sections, n_crossing, section_tokens array<double>): a row per row of docs.

    lengths is an array of the sections' lengths in code points, in order; the last section ends with the text whatever its length. The
    counts of a document add up to n_tokens under each rule. A null or empty text has no token, and its sections have 0
    each; null or no lengths are one section, and a null length is 0. Ids may be null or repeat. Other columns are ignored. No rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    held = docs.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lengths.cast("array<int>").alias("lengths"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        size = np.zeros(max(c.lengths) + 1, np.int64)
        for rank, n in c.lengths.items():
            size[rank] = n
        for batch in slices(batches, "text"):
            tokens, sections, crossing, counts = [], [], [], []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("lengths").to_pylist()):
                ids = np.array(c.encode(text), np.int64)
                bounds = np.minimum(np.cumsum([0, *(n or 0 for n in (parts or [0])[:-1])]), len(text))
                bounds = np.append(bounds, len(text))
                per, cross = allocate(*token_spans(text, size[ids]), bounds, rule)
                tokens.append(len(ids))
                sections.append(len(bounds) - 1)
                crossing.append(cross)
                counts.append(per)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(tokens, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossing, pa.int64()), pa.array(counts, pa.list_(pa.float64()))],
                ["id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )
        c.forget()
        let_go()

    return frame.mapInArrow(run, f"id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>").withColumnRenamed("id", id_col)


def line_lengths(text: Column) -> Column:
    """The lengths of lines in code points, each with its newline. Null for null."""
    return F.transform(F.split(text, "\n"), lambda line: F.char_length(line) + 1)


def fields(names: list[str], gap: str = "\n") -> tuple[Column, Column]:
    """The text of several columns joined by gap, nulls as empty, and the lengths of its fields, each with the gap after it."""
    values = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    return F.concat_ws(gap, *values), F.array(*[F.char_length(v) + len(gap) for v in values])
