"""Alignment of two tokenizers' tokens of the same bytes, with counts of aligned id pairs over a whole corpus.

A pair of ids is packed into one int64, the second tokenizer's id in the upper half. Each task makes partial counts with
np.unique; these are dealt out by ranges of the key, sorted, and runs of one key are summed as they are written, so that
the shards together are one sorted table of distinct keys. The shards are plain arrays in the shared folder; workers map them into memory
and look keys up by binary search. Their size is bounded by the product of the vocabularies, not by the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import tiktoken
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialize, release, shared_folder, slices

#: Distinct keys that a task holds before it gives back partial counts.
HELD = 1 << 21
#: A vocabulary file above this size is not broadcast.
MOST_FILE_BYTES = 64 << 20
LOW = np.int64((1 << 32) - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 signs for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Tokens of a byte-level BPE file of the tokenizers library, of a space and the text.

    With the pattern by which that library cuts texts, a file whose ids are in the order of its merges is a table of ranks, and tiktoken gives the same ids in a
    fifth of the time. Any other file, and any without a pattern, is left to the library.
    """

    def __init__(self, data: bytes, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_of[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.ranked = self._ranked(json.loads(data), pattern) if pattern else None

    def _ranked(self, file: dict, pattern: str) -> tiktoken.Encoding | None:
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        merges = ["".join(m.split(" ", 1) if isinstance(m, str) else m) for m in model.get("merges", [])]
        ids = [model["vocab"].get(m) for m in merges]
        plain = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file.get("normalizer")
        if not plain or model.get("dropout") or ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {self.bytes_of[k]: k for k in range(256 + len(ids))}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(ids) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokens of a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        piece = self.model.id_to_piece
        self.bytes_of = [bytes([int(piece(k)[3:-1], 16)]) if self.model.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(self.model.vocab_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_made: dict[str, object] = {}


def tokenizer(kind: type, data: bytes, *options):
    """The worker's tokenizer of this file, built once per process."""
    key = f"{kind.__name__} {hashlib.sha256(data).hexdigest()} {options}"
    if key not in _made:
        _made[key] = kind(data, *options)
    return _made[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_FILE_BYTES + 1)
    if len(data) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return data


@dataclass
class Encoded:
    """The ids of both tokenizers for each text, (id, a, b) with packed ids, and what their ids stand for."""

    frame: DataFrame
    a_lengths: Broadcast
    b_lengths: Broadcast
    id_col: str

    @property
    def width(self) -> str:
        return "<u2" if max(len(self.a_lengths.value), len(self.b_lengths.value)) <= 1 << 16 else "<u4"


def encode_both(docs: DataFrame, a_path: str, b_path: str, a_pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Encoded:
    """Encode whole texts by a byte-level file (a) and a sentencepiece model (b), once; the ids are a table in the shared folder. See ByteLevel for a_pattern.

    A text that is null or empty, or that either tokenizer doesn't give back byte by byte (with one space before it), has no ids.
    Ids of rows may be null or repeat: rows are handled one by one. Other columns are ignored, whatever their names. No rows give no rows.
    """
    context = docs.sparkSession.sparkContext
    files = context.broadcast((_file(a_path), _file(b_path)))
    a_bytes, b_bytes = ByteLevel(files.value[0]).bytes_of, Pieces(files.value[1]).bytes_of
    lengths = [context.broadcast(np.array([len(x) for x in table], np.int64)) for table in (a_bytes, b_bytes)]
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = Encoded(frame, *lengths, id_col)
    code = "H" if out.width == "<u2" else "I"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer(ByteLevel, files.value[0], a_pattern), tokenizer(Pieces, files.value[1])
        of_a, of_b = a.bytes_of.__getitem__, b.bytes_of.__getitem__
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            packed: tuple[list, list] = ([], [])
            for text, x, y in zip(texts, a.encode(texts), b.encode(texts)):
                want = b" " + text.encode()
                fits = text and b"".join(map(of_a, x)) == want and b"".join(map(of_b, y)) == want
                for out_, ids in zip(packed, (x, y)):
                    out_.append(array(code, ids if fits else ()).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(p, pa.binary()) for p in packed)], ["id", "a", "b"])
        let_go()

    out.frame = materialize(frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, a binary, b binary"), "crosstok", codec="zstd")
    return out


def unpack(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a column, joined, and the bounds of each row within them."""
    bounds = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)))) // np.dtype(width).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), width).astype(np.int64), bounds


class Links:
    """How the tokens of some texts meet: joined, both tokenizers' tokens cover the same bytes, and each text ends where both end."""

    def __init__(self, batch: pa.RecordBatch, width: str, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a, self.a_bounds = unpack(batch.column("a"), width)
        self.b, self.b_bounds = unpack(batch.column("b"), width)
        self.a_ends, b_ends = np.cumsum(a_lengths[self.a]), np.cumsum(b_lengths[self.b])
        sides = np.zeros(1 + (int(self.a_ends[-1]) if len(self.a_ends) else 0), np.uint8)
        sides[self.a_ends] = 1
        sides[b_ends] += 2
        # An interval between neighbouring ends lies in one token of each, and each overlapping pair has just one such interval.
        self.ends = np.flatnonzero(sides)
        here = sides[self.ends]
        self.of_a, self.of_b = (np.cumsum(x) - x for x in ((here & 1).astype(np.int64), (here >> 1).astype(np.int64)))
        self.both = here == 3
        self.keys = self.b[self.of_b] << 32 | self.a[self.of_a]

    def text_ends(self) -> np.ndarray:
        """The number of links up to each text's end."""
        return np.searchsorted(self.ends, np.concatenate(([0], self.a_ends))[self.a_bounds[1:]], "right")

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of groups, a's before b's, and the sign after each: 0 in a run of one tokenizer's, 1 from a's to b's, 2 at a group's end."""
        a_of, b_of = self.of_a[self.both], self.of_b[self.both]  # the last token of either in each group
        a_sizes, b_sizes = np.diff(a_of, prepend=-1), np.diff(b_of, prepend=-1)
        ids, signs = np.zeros(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int8)
        at_a = np.arange(len(self.a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
        at_b = np.arange(len(self.b)) + np.repeat(np.cumsum(a_sizes), b_sizes)
        ids[at_a], ids[at_b] = self.a, self.b
        signs[at_a[a_of]], signs[at_b[b_of]] = 1, 2
        return ids, signs


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def pair_counts(encoded: Encoded) -> DataFrame:
    """Partial counts of linked id pairs: (key, n), at most one row a key for each HELD distinct keys of a task."""
    width, a_lengths, b_lengths = encoded.width, encoded.a_lengths, encoded.b_lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, "a"):
            keys, counts = np.unique(Links(batch, width, a_lengths.value, b_lengths.value).keys, return_counts=True)
            if len(keys):
                held.append((keys, counts.astype(np.int64)))
            if sum(len(k) for k, _ in held) > HELD:
                held = [summed(*map(np.concatenate, zip(*held)))]
                if 2 * len(held[0][0]) > HELD:
                    yield give(*held.pop())
        if held:
            yield give(*summed(*map(np.concatenate, zip(*held))))
        del held
        let_go()

    return encoded.frame.select("a", "b").mapInArrow(run, "key long, n long")


@dataclass
class Shards:
    """A sorted table of distinct keys and their counts, in files by ranges of the key; best has the highest count of each id of b."""

    names: list[str]
    firsts: np.ndarray
    best: np.ndarray
    folder: str
    mapped: bool
    opened: dict = field(default_factory=dict)

    def _arrays(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.opened:
            at = f"{self.folder if self.mapped else SparkFiles.get(self.folder)}/{self.names[k]}"
            self.opened[k] = tuple(np.memmap(f"{at}.{part}", "<i8", "r") for part in ("keys", "counts"))
        return self.opened[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, which are sorted and all in the table."""
        out = np.zeros(len(keys), np.int64)
        edges = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for k in np.flatnonzero(np.diff(edges)):
            part = slice(edges[k], edges[k + 1])
            table, counts = self._arrays(int(k))
            at = np.minimum(np.searchsorted(table, keys[part]), len(table) - 1)
            if (table[at] != keys[part]).any():
                raise KeyError("a pair of ids without a count")
            out[part] = counts[at]
        return out

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}


def count_shards(partial: DataFrame, b_size: int, mounted: bool = True) -> Shards:
    """Write the sums of partial counts (key, n) as sorted shards. A task streams its range to its own files, whose names it gives
    back, so that what a lost task has left is never read.

    A shared folder with a file: address is mapped where it is mounted; from any other store (or if mounted is False) Spark copies the
    shards to each executor once, as it does with files of a job. b_size is the size of the second vocabulary.
    """
    spark = partial.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    store, base = _store(uri)
    store.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = _store(uri)[0], uuid.uuid4().hex
        best, first, last = np.zeros(b_size, np.int64), None, None
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [store.open_output_stream(f"{base}/{name}.{part}") for part in ("keys", "counts")]
            keys, counts = (batch.column(c).to_numpy().astype("<i8") for c in ("key", "n"))
            if last is not None:
                keys, counts = np.append(last[0], keys), np.append(last[1], counts)
            keys, counts = summed(keys, counts)
            first = int(keys[0]) if first is None else first
            last = (keys[-1:], counts[-1:])  # its run may go on in the next batch
            _put(files, best, keys[:-1], counts[:-1])
        if files is not None:
            _put(files, best, *last)
            for f in files:
                f.close()
            ids = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([best[ids].tolist()], pa.list_(pa.int64()))], ["name", "first", "ids", "best"])
        let_go()

    partial = materialize(partial, "pair-counts")  # finding ranges takes a pass of its own
    # A row a range, and the ids of one vocabulary: bounded whatever the corpus is.
    rows = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "name string, first long, ids array<long>, best array<long>").collect()
    release(partial)
    rows.sort(key=lambda r: r["first"])
    best = np.zeros(b_size, np.int64)
    for r in rows:
        np.maximum.at(best, np.array(r["ids"], np.int64), np.array(r["best"], np.int64))
    mapped = mounted and uri.startswith("file:")
    if not mapped:
        spark.sparkContext.addFile(uri, recursive=True)
    return Shards([r["name"] for r in rows], np.array([r["first"] for r in rows], np.int64), best, base if mapped else path.getName(), mapped)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A shared folder that Python can write to, and the path in it."""
    return (pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def _put(files: list, best: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
    files[0].write(keys.astype("<i8").tobytes())
    files[1].write(counts.astype("<i8").tobytes())
    np.maximum.at(best, keys >> 32, counts)


def alignments(encoded: Encoded, shards: Shards) -> DataFrame:
    """For each text (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups).

    groups writes the ids of each group as `a1,a2|b1;a3|b2,b3`: the texts' bytes are cut wherever tokens of both end. A link is a pair
    of tokens that share a byte; its count is how many links of the whole corpus have its two ids, and it is a best one if no other
    pair of the same id of b has a higher count. A text without ids has zeros and an empty string.
    """
    width, a_lengths, b_lengths = encoded.width, encoded.a_lengths, encoded.b_lengths
    held = encoded.frame.sparkSession.sparkContext.broadcast(shards)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        size = max(len(a_lengths.value), len(b_lengths.value))
        names = [f"{k}{sign}" for sign in ",|;" for k in range(size)].__getitem__
        for batch in slices(batches, "a"):
            links = Links(batch, width, a_lengths.value, b_lengths.value)
            until = np.concatenate(([0], links.text_ends()))
            keys, back = np.unique(links.keys, return_inverse=True)
            counts = table.counts(keys)
            best = (counts == table.best[keys >> 32])[back]
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[until])
            ids, signs = links.written()
            codes, bounds = (ids + size * signs.astype(np.int64)).tolist(), (links.a_bounds + links.b_bounds).tolist()
            groups = ["".join(map(names, codes[x:y]))[:-1] for x, y in zip(bounds, bounds[1:])]
            of = [np.diff(links.a_bounds), np.diff(links.b_bounds), total(links.both), np.diff(until), total(best), total(counts[back])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x.astype(np.int64)) for x in of), pa.array(groups, pa.string())], ["id", *numbers, "groups"])
        let_go()

    kind = encoded.frame.schema["id"].dataType.simpleString()
    return encoded.frame.mapInArrow(run, f"id {kind}, {', '.join(n + ' long' for n in numbers)}, groups string").withColumnRenamed("id", encoded.id_col)


def align(docs: DataFrame, a_path: str, b_path: str, a_pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_both, count_shards and alignments of whole texts."""
    encoded = encode_both(docs, a_path, b_path, a_pattern, id_col, text_col)
    return alignments(encoded, count_shards(pair_counts(encoded), len(encoded.b_lengths.value)))
