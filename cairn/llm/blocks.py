"""Comparing the members of groups of any size: groups are cut into blocks, and pairs of blocks are the tasks.

A group of g members has ceil(g / block) hashed blocks; each pair of blocks is compared on its own, with
bounded memory, and gives a spanning forest of its links, not the links themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt


def block_pairs(members: DataFrame, group: list[str], node: str, block: int) -> DataFrame:
    """members, once for each pair of blocks of its group that it takes part in: two columns more, _i <= _j, and _b, its own.

    Groups of one member go. Members of a group that fits in one block are given once.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_size")).where("_size > 1")
    blocks = F.ceil(F.col("_size") / block)
    out = members.join(sizes, group).withColumn("_b", F.pmod(F.xxhash64(node), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o", "_size")


def map_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """run on the rows of each combination of keys, many small groups to a batch.

    The rows are dealt out and sorted by the keys; groups are cut from the stream of batches, so that a group
    costs no more than its rows. run gets an Arrow table and gives a batch by schema, or None.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(table: pa.Table, last: bool):
            changed = np.zeros(max(0, table.num_rows - 1), bool)
            for k in keys:
                column = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
                changed |= column[1:] != column[:-1]
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), table.num_rows]
            done = edges if last else edges[:-1]
            outs = [out for a, b in zip(done[:-1], done[1:]) if b > a and (out := run(table.slice(a, b - a))) is not None]
            return outs, table.slice(done[-1])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            outs, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
            yield from joined(outs)
            held = rest.to_batches()
        if held:
            outs, _ = cut(pa.Table.from_batches(held).combine_chunks(), True)
            yield from joined(outs)

    def joined(outs):
        if outs:
            yield from pa.Table.from_batches(outs).combine_chunks().to_batches()

    return dealt(df, *keys).sortWithinPartitions(*keys).mapInArrow(over, schema)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as (node, parent), of the graph with this symmetric boolean matrix."""
    n, seen, edges = len(linked), np.zeros(len(linked), bool), []
    for root in np.flatnonzero(linked.any(axis=1)):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            edges += [(int(x), int(at)) for x in new]
            stack += new.tolist()
        if seen.sum() == n:
            break
    return edges


def forest_of_blocks(linked: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """As forest, of a pair of blocks, without what either block's own task gives: edges that join parts of the one with parts of the other.

    An edge names a member of each part, which need not be the linked ones. So a large group of copies gives an edge or so for each pair of blocks.
    """
    if (block == block[0]).all():
        return forest(linked)
    head = np.arange(len(linked))
    for node, parent in forest(linked & (block[:, None] == block[None, :])):  # parents come before their children
        head[node] = head[parent]
    heads, part = np.unique(head, return_inverse=True)
    member = np.zeros((len(linked), len(heads)), np.float32)
    member[np.arange(len(linked)), part] = 1
    met = member.T @ linked.astype(np.float32) @ member > 0
    np.fill_diagonal(met, False)
    return [(int(heads[a]), int(heads[b])) for a, b in forest(met)]
