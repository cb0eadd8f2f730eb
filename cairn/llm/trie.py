"""Prefix trie of conversations: nodes by digest, and pointer jumping for what adds up over subtrees.

The digest of a conversation's first d turns is made of sums of hashes of (place, role, text), so that it can be summed up over parts of
a conversation of any length. Each node names its parent by digest. In each doubling round a node hands what it has gathered to the
ancestor that it points at, and points on to where that one points; after as many rounds as the depth has binary digits every node has
gathered its whole subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt
from .common import let_go, materialize, release

#: Width of the ranges of conversation ids whose ends are joined to one text.
PIECE = 256
PARTS = ["s0", "s1", "s2", "s3"]
KEY = ["k1", "k2"]


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, m, bytes) of each turn: a digest of role and text (null: empty), and the text's UTF-8 length. Turns of no conversation (null) go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("r"), text.alias("t"))
    return rows.select("conv", "turn", F.md5(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary")).alias("m"), F.octet_length("t").cast("long").alias("bytes"))


def placed(digests: DataFrame) -> DataFrame:
    """digests with slot and pos: their place (from 1) in the conversation by turn (null first), equal turns by digest.

    Rows are dealt out by ranges of (conv, turn, digest), so that a conversation of any length is many tasks; slot is the range.
    """
    ranged = materialize(digests.repartitionByRange("conv", F.asc_nulls_first("turn"), "m").withColumn("slot", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv", "slot").agg(F.count("*").alias("n"))
    before = counts.select("conv", "slot", (F.sum("n").over(Window.partitionBy("conv").orderBy("slot")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv", "slot").orderBy(F.asc_nulls_first("turn"), "m"))
    return ranged.join(before, ["conv", "slot"]).select("conv", "slot", (F.col("before") + within).alias("pos"), "m", "bytes")


def share_heads(rows: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as the first head turns of conversation base, then their own turns after their first head.

    base and head are expressions of the column conv; head is at most the given number. Returns (conv) of all, and their turns as of placed().
    A base that is absent gives no turns, a short one all it has.
    """
    sizes = materialize(rows.groupBy("conv").agg(F.max("pos").alias("n")), "sizes")
    convs = sizes.select("conv", base.alias("base"), head.cast("long").alias("head"))
    held = sizes.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("held"))
    shift = convs.join(held, "base", "left").select("conv", "head", F.least("head", F.coalesce("held", F.lit(0))).alias("shared"))
    own = rows.where(F.col("pos") > head).join(shift, "conv").select("conv", "slot", (F.col("pos") - F.col("head") + F.col("shared")).alias("pos"), "m", "bytes")
    first = rows.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "m", "bytes")
    lent = convs.join(first, "base").where(F.col("pos") <= F.col("head")).select("conv", F.lit(-1).alias("slot"), "pos", "m", "bytes")
    return sizes.select("conv"), own.unionByName(lent)


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    """Two halves of the digest of so many turns with these sums."""
    return [F.xxhash64(F.lit(salt), depth, *sums).alias(k) for salt, k in zip((11, 29), KEY)]


def prefixes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each prefix of each conversation (conv, depth, k1, k2, p1, p2, bytes): its digest, the digest without its last turn, that turn's size;
    and the whole of each (conv, k1, k2). rows are as of placed(), convs the conversations, those without turns too."""
    halves = [F.xxhash64(F.lit(salt), "pos", "m") for salt in (3, 7)]
    parts = [f for h in halves for f in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]  # sums of 32 bits don't overflow
    rows = materialize(rows.select("conv", "slot", "pos", "bytes", *(p.alias(s) for p, s in zip(parts, PARTS))), "prefixes")
    slots = materialize(rows.groupBy("conv", "slot").agg(F.count("*").alias("n"), *(F.sum(s).alias(s) for s in PARTS)), "slots")
    over = Window.partitionBy("conv").orderBy("slot")
    before = slots.select("conv", "slot", *((F.sum(s).over(over) - F.col(s)).alias("b" + s) for s in PARTS))
    run = Window.partitionBy("conv", "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(before, ["conv", "slot"]).select("conv", F.col("pos").alias("depth"), "bytes", *PARTS, *((F.col("b" + s) + F.sum(s).over(run)).alias("t" + s) for s in PARTS))
    here = _key(F.col("depth"), [F.col("t" + s) for s in PARTS])
    above = [c.alias(p) for c, p in zip(_key(F.col("depth") - 1, [F.col("t" + s) - F.col(s) for s in PARTS]), ("p1", "p2"))]
    whole = convs.join(slots.groupBy("conv").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in PARTS)), "conv", "left")
    return summed.select("conv", "depth", *here, *above, "bytes"), whole.select("conv", *_key(F.coalesce("n", F.lit(0)).cast("long"), [F.coalesce(s, F.lit(0)).cast("long") for s in PARTS]))


def nodes_of(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, conv_id, n_convs, bytes) of each distinct prefix: the smallest member, how many, the last turn's size.
    The root has the depth 0 and no parent; without conversations there is none."""
    zero = [F.lit(0).cast("long")] * len(PARTS)
    least = [F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")]
    nodes = prefixes.groupBy(*KEY).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), *least, F.first("bytes").alias("bytes"))
    root = convs.agg(*least).where("n_convs > 0").select(*_key(F.lit(0).cast("long"), zero), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    return nodes.unionByName(root)


def roll_up(tree: DataFrame, values: list[str], key: list[str] = KEY, parent: list[str] = ["p1", "p2"]) -> DataFrame:  # noqa: B006
    """(key, values): of each node the sums of the values over its subtree, itself included. Roots have null parents; a parent is a node.

    Round k: a node has the sums of all below it that are less than 2**k away, and points at its ancestor 2**k above. What it has goes to that
    ancestor (added up before the shuffle, so that a node with very many below it is no bottleneck), and it then points where that one does.
    Nodes that point past a root are done handing on; rounds end when all are. Each round is a table in the shared folder.
    """
    up = [f"_{k}" for k in key]
    now = materialize(tree.select(*key, *(F.col(p).alias(u) for p, u in zip(parent, up)), *values), "rollup")
    while now.where(F.col(up[0]).isNotNull()).limit(1).count():
        going = now.where(F.col(up[0]).isNotNull())
        gained = going.groupBy(*(F.col(u).alias(k) for u, k in zip(up, key))).agg(*(F.sum(v).alias("g_" + v) for v in values))
        further = now.select(*(F.col(k).alias(u) for k, u in zip(key, up)), *(F.col(u).alias("n" + u) for u in up))
        pointed = now.join(further, up, "left").select(*key, *(F.col("n" + u).alias(u) for u in up), *values)
        step = pointed.join(gained, key, "left").select(*key, *up, *((F.col(v) + F.coalesce("g_" + v, F.lit(0))).alias(v) for v in values))
        after = materialize(step, "rollup")
        release(now)
        now = after
    return now.select(*key, *values)


def end_texts(whole: DataFrame) -> DataFrame:
    """(k1, k2, piece, ids) of the conversations that end at a node: their ids in order, joined by commas, in one text for each range of PIECE ids."""
    piece = (F.col("conv") - F.pmod("conv", F.lit(PIECE))) / PIECE
    return whole.groupBy(*KEY, piece.alias("piece")).agg(F.array_join(F.sort_array(F.collect_set("conv")).cast("array<string>"), ",").alias("ids"))


def end_digests(pieces: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the joined ids of a node's pieces.

    A node of one piece is hashed in place. The pieces of any other reach one hash in order; a digest of one text can't be made in parts, but a
    task holds no more than a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")))
            done: list[tuple] = []
            for k1, k2, ids in rows:
                if (k1, k2) != at:
                    if at is not None:
                        done.append((*at, running.hexdigest()))
                    at, running = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, running.hexdigest())], [*KEY, "ends_sha256"])
        let_go()

    many = pieces.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    one = many.where("n = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    rest = dealt(pieces.join(many.where("n > 1").select(*KEY), KEY, "left_semi"), *KEY).sortWithinPartitions(*KEY, "piece")
    return one.unionByName(rest.mapInArrow(run, "k1 long, k2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, heads: tuple[Column, Column, int] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The trie of conversations by their turns (role, text), from the textless root on.

    Returns its nodes (k1, k2, p1, p2, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), and the conversations with their
    last node (conv, k1, k2). conv_id is the smallest conversation that starts with the node's turns; saved_tokens is what storing shared turns
    once saves below and at the node, in bytes. heads, if given, are the arguments of share_heads. A null role or text counts as empty, turns of
    no conversation (null) are ignored, equal turns are ordered by a digest of role and text and repeated ones stay. Other columns are ignored. No rows give no nodes.
    """
    rows = materialize(placed(turn_digests(turns, conv_col, turn_col, role_col, text_col)), "placed")
    convs, rows = share_heads(rows, *heads) if heads else (rows.select("conv").distinct(), rows)
    below, whole = prefixes(rows, convs)
    nodes = materialize(nodes_of(below, convs), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    names = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).join(names, ["p1", "p2"], "left")
    full = materialize(full.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "tree")
    release(nodes)
    sums = roll_up(full, ["leaf", "saved"]).select(*KEY, F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = full.drop("leaf", "saved", "bytes").join(sums, KEY)
    return out.select(*KEY, "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), whole
