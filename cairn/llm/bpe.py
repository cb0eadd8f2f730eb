"""Byte-level BPE encoding and decoding with a public rank file.

The vocabulary's tokens become Latin-1 strings, one character a byte, in an Aho-Corasick automaton
over reversed tokens: one pass over a reversed piece of text gives the longest token that starts at
each byte. A backtracking walk takes the longest token whose neighbour on the left it is compatible
with, falls back to the token's own longest proper prefix in the vocabulary, and steps back when none
is left. Two tokens are compatible when merging their joined bytes by rank gives just these two;
that answer is memoised, so that the walk is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, slices

#: Entries of a worker's memos before they are cleared. They bound memory, never results.
MEMO = 1 << 17
#: A vocabulary is broadcast as its file; a rank file above this size is refused.
MOST_RANK_BYTES = 64 << 20
#: Rows of ids that are decoded at a time.
DECODED = 256


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Pieces(dict):
    """The ids of pieces of text; a missing one is encoded. Cleared between texts, by its user."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode()))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes by one rank file's bytes and one split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines()) if t}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.lengths = {r: len(t) for r, t in self.bytes_of.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.compatible_memo: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.pieces = Pieces(self.encode_bytes)
        self.prefix_memo: dict[int, int | None] = {}

    def shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if rank not in self.prefix_memo:
            token = self.bytes_of[rank]
            self.prefix_memo[rank] = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.prefix_memo[rank]

    def spine(self, rank: int, side: int) -> list[tuple[bytes, int, int]]:
        """The tokens that stand at this token's left (side 0) or right (1) edge while it is built.

        Each with the rank of the merge that makes it and of the one that takes it up.
        """
        known = self.spines[side].get(rank)
        if known is None:
            token, until, known = self.bytes_of[rank], 1 << 60, []
            while True:
                made = self.ranks[token] if len(token) > 1 else -1
                known.append((token, made, until))
                if len(token) == 1:
                    break
                parts = merge(token, {t: r for t, r in self.parts_of(token) if r != made})
                token, until = self.bytes_of[parts[-side]], made
            self.spines[side][rank] = known
        return known

    def parts_of(self, token: bytes) -> list[tuple[bytes, int]]:
        """The vocabulary's tokens within a token, with their ranks."""
        n = len(token)
        return [(t, self.ranks[t]) for i in range(n) for j in range(i + 1, n + 1) if (t := token[i:j]) in self.ranks]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined bytes gives just these two. Memoised.

        It does unless, at some time, the edge tokens next to the boundary would merge before either is taken
        up on its own side. Of equal ranks the leftmost merges first.
        """
        if len(self.compatible_memo) >= 2 * MEMO:
            self.compatible_memo.clear()
        ranks, answer = self.ranks, True
        for a, a_made, a_until in self.spine(left, 1):
            for b, b_made, b_until in self.spine(right, 0):
                if a_made < b_until and b_made < a_until:
                    rank = ranks.get(a + b)
                    if rank is not None and rank < a_until and rank <= b_until:
                        answer = False
        self.compatible_memo[left << 32 | right] = answer
        return answer

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if data in self.ranks:
            return [self.ranks[data]]
        n = len(data)
        # The automaton reports the longest token at each end of the reversed bytes first: turned round, it is the one a dict keeps.
        longest = dict(list(self.automaton.iter(data[::-1].decode("latin-1")))[::-1])
        if len(longest) < n:
            raise ValueError("a byte has no token of its own in the rank file")
        lengths, memo = self.lengths, self.compatible_memo
        dead = bytearray(n + 1)  # ends from which no walk can go on
        out: list[int] = []
        at, token, last = 0, longest[n - 1], None
        while True:
            while token is not None:
                end = at + lengths[token]
                if not dead[end]:
                    if last is None:
                        break
                    fits = memo.get(last << 32 | token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = self.shorter(token)
            if token is None:
                dead[at] = 1
                last = out.pop()
                at -= lengths[last]
                token = self.shorter(last)
                last = out[-1] if out else None
                continue
            out.append(token)
            if end == n:
                return out
            last, at, token = token, end, longest[n - 1 - end]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, piece by piece, without special tokens."""
        if len(self.pieces) >= MEMO:
            self.pieces.clear()
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def forget(self) -> None:
        """Empty the memo of pieces, so that an idle worker holds little more than the vocabulary."""
        self.pieces.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary, built once per process."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def rank_bytes(path: str) -> bytes:
    """A rank file, read on the driver. Its size is checked, for it is broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return data


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts: (id_col, ids array<int>, n_tokens long), one row per row of docs.

    A null text is taken as empty and gives no ids, as does an empty one. Ids may be null or repeat:
    rows are handled one by one. Other columns of docs are ignored, whatever their names. No rows
    give no rows. A very long text is encoded piece by piece; a piece is never cut.
    """
    held = docs.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for batch in slices(batches, "text"):
            flat, counts = array("i"), []
            for text in batch.column("text"):
                ids = c.encode(text.as_py())
                flat.extend(ids)
                counts.append(len(ids))
            ends = np.cumsum([0, *counts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, np.array(flat, np.int32)), pa.array(counts, pa.int64())], ["id", "ids", "n_tokens"])
        c.forget()
        let_go()

    return frame.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids: (id_col, decoded binary). Null ids are taken as none; an id outside the ranks raises KeyError."""
    held = encoded.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))
    frame = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED):
                part = batch.slice(at, DECODED)
                out = [c.decode(x.as_py() or []) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], ["id", "decoded"])
        let_go()

    return frame.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_encode, then decode, per row: (id_col, n_tokens, ids_sha256, decoded_sha256).

    Encoding and decoding share one pass, so that ids are not moved between two Python stages.
    Nulls, empty texts and repeated rows are taken as in bpe_encode.
    """
    held = docs.sparkSession.sparkContext.broadcast(rank_bytes(rank_path))
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        names = {r: str(r) for r in c.bytes_of}.__getitem__
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in slices(batches, "text"):
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py())
                counts.append(len(ids))
                of_ids.append(sha(" ".join(map(names, ids)).encode()))
                of_bytes.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        c.forget()
        let_go()

    return frame.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
