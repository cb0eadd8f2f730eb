"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking by cosine."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, forest_of_blocks, map_groups
from .common import components, let_go, materialize, release

#: Rows that the rotations are fitted on, those of smallest hash. Every row is coded and indexed.
SAMPLE = 20_000
#: Bits of a substring, each of which is a table, at least; more of them where a table would have over BUCKET vectors for each key.
SUBSTRING, BUCKET = 16, 16
#: Odds that a pair at the threshold has no substring in common, from which the number of tables follows.
MISSED = 0.005
#: Standard deviations above the expected distance of a pair at the threshold that a candidate's codes may be apart.
SLACK = 6.0
BLOCK, ITERATIONS = 256, 30
#: Components that are multiplied with random directions at a time.
CHUNK = 1_024


def plan_tables(count: int, threshold: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for so many vectors: longer substrings for more of them, and tables enough for the odds MISSED."""
    bits = min(32, max(SUBSTRING, math.ceil(math.log2(max(1, count) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - same))


def fit_rotations(sample: np.ndarray, bits: int, seed: int = 1) -> np.ndarray:
    """The first bits columns of rotations side by side: (dim, bits).

    Each rotation starts at random on the principal axes, and then by turns takes the signs of the rotated
    sample, less its mean, as its binary code and the rotation that brings the sample closest to that code.
    """
    dim = sample.shape[1]
    centred = sample - sample.mean(axis=0)
    axes = np.linalg.eigh(centred.T @ centred)[1]
    rng, found = np.random.default_rng(seed), []
    for _ in range(-(-bits // dim)):
        turned, rotation = centred @ axes, np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(ITERATIONS):
            code = np.where(turned @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(turned.T @ code)
            rotation = u @ v
        found.append(axes @ rotation)
    return np.hstack(found)[:, :bits]


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by the largest component first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows of a batch that have only finite components, not all 0, and these as doubles."""
    found: dict[int, tuple[list, list]] = {}
    for k, v in enumerate(column):
        if v.is_valid and len(v) and not v.values.null_count:
            a = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(a).all() and a.any():
                rows, out = found.setdefault(len(a), ([], []))
                rows.append(k)
                out.append(a)
    return {dim: (np.array(rows), np.array(out)) for dim, (rows, out) in found.items()}


def projections(unit: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """unit @ rotations. Vectors of another length than the rotations' meet random directions, made from a seed a CHUNK of components at a time."""
    dim, bits = unit.shape[1], rotations.shape[1]
    if dim == len(rotations):
        return unit @ rotations
    out = np.zeros((len(unit), bits))
    for at in range(0, dim, CHUNK):
        part = unit[:, at : at + CHUNK]
        out += part @ np.random.default_rng((dim, at)).standard_normal((part.shape[1], bits))
    return out


def codes(unit: np.ndarray, rotations: np.ndarray, bits: int) -> np.ndarray:
    """Codes, a row a vector, as a number for each substring of so many bits.

    No mean is taken off: signs then turn over with the angle that the threshold is about, and most_apart() holds for vectors with a common direction too.
    """
    signs = (projections(unit, rotations) >= 0).reshape(len(unit), -1, bits)
    return (signs @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))).astype(np.uint32)


def most_apart(threshold: float, bits: int) -> int:
    """The most bits by which codes of a pair at the threshold differ: a sign turns over with odds angle / pi."""
    odds = math.acos(threshold) / math.pi
    return math.ceil(bits * odds + SLACK * math.sqrt(bits * odds * (1 - odds)))


def _candidates(table: pa.Table, apart: int) -> np.ndarray:
    """The candidates of a pair of blocks of one table's bucket, as a matrix: codes near enough, and no earlier table in which the two meet.

    The members of each block are left to its own task. So each candidate of all tables is in one task only.
    """
    block, earlier = table.column("_b").to_numpy(), table.column("t")[0].as_py()
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint32).reshape(len(block), -1)
    distance, met = np.zeros((len(block), len(block)), np.int32), np.zeros((len(block), len(block)), bool)
    for t, word in enumerate(code.T):
        apart_here = np.bitwise_count(word[:, None] ^ word[None, :])
        distance += apart_here
        if t < earlier:
            met |= apart_here == 0
    found = (distance <= apart) & ~met
    if table.column("_i")[0] != table.column("_j")[0]:
        found &= block[:, None] != block[None, :]
    np.fill_diagonal(found, False)
    return found


def with_candidates(table: pa.Table, apart: int) -> pa.RecordBatch | None:
    """The members of a pair of blocks that have a candidate in it: (t, dim, key, node)."""
    has = _candidates(table, apart).any(axis=1)
    return table.select(["t", "dim", "key", "node"]).filter(pa.array(has)).combine_chunks().to_batches()[0] if has.any() else None


def cosine_links(table: pa.Table, apart: int, threshold: float) -> pa.RecordBatch | None:
    """Of a pair of blocks: a forest of the links as rows (a, b, null), and rows (a, null, n) of the rows that a's links lead to.

    Only candidates of this bucket are counted; the forest is of all links among the members.
    """
    candidates, nodes = _candidates(table, apart), table.column("node").to_numpy()
    unit = units(np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(nodes), -1))
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    found = np.array(forest_of_blocks(linked, table.column("_b").to_numpy()), np.int64).reshape(-1, 2)
    to = (linked & candidates) @ table.column("copies").to_numpy().astype(np.float64)
    has = np.flatnonzero(to)
    if not len(found) and not len(has):
        return None
    a, b = nodes[found[:, 0]], nodes[found[:, 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([a, nodes[has]])), pa.array([*b.tolist(), *[None] * len(has)], pa.int64()), pa.array([*[None] * len(a), *to[has].astype(int).tolist()], pa.int64())], ["a", "b", "n"]
    )


def coded(vectors: DataFrame, rotations: np.ndarray, bits: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, cls, dim, vector, code): cls names the vector's components in 128 bits; all but id are null where the vector can't be compared."""
    held = vectors.sparkSession.sparkContext.broadcast(rotations)
    frame = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cls, dims, raw, code = [None] * n, [None] * n, [None] * n, [None] * n
            for dim, (rows, found) in usable(batch.column("v")).items():
                for k, v, c in zip(rows.tolist(), found + 0.0, codes(units(found), held.value, bits)):
                    raw[k], code[k], dims[k] = v.tobytes(), c.tobytes(), dim
                    cls[k] = hashlib.blake2b(raw[k], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cls, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(code, pa.binary())], ["id", "cls", "dim", "vector", "code"])
        let_go()

    return frame.mapInArrow(run, f"id {kind}, cls binary, dim int, vector binary, code binary")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of vectors by cosine: (id_col, n_links, component_id, kept), a row per row.

    Codes from learned rotations are cut into substrings, each a table in which vectors of the same key whose codes are close enough are
    candidates. The length of a substring follows from the number of vectors, the number of tables from the odds MISSED that a pair at the
    threshold meets in none (plan_tables). Each candidate is reranked once, in the first table where it meets, by the cosine of the original
    vectors in double precision; only members with candidates are joined with their vectors. Large buckets are compared in
    pairs of blocks that give link counts and spanning forests. Equal vectors are one class with a count.

    The rotations are learned for the commonest length of vectors, the shortest of equally common ones; vectors of other lengths have codes of
    random directions. Vectors of different lengths are never linked. Vectors that are null, zero, or hold null or non-finite
    components have n_links 0 and their own id as component_id. Ids may repeat; null ids count for no component's
    smallest id, and kept is then false. Other columns are ignored. No rows give no rows.
    """
    sizes = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("dim")).count()
    total = sizes.agg(F.sum("count").alias("n"), F.min_by("dim", F.struct(-F.col("count"), "dim")).alias("dim")).first()
    dim = total["dim"] or 1
    bits, tables = plan_tables(total["n"] or 0, threshold)
    sample = vectors.where(F.size(vector_col) == dim).select(F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    found = usable(sample.column("v").combine_chunks()).get(dim)
    rotations = fit_rotations(np.eye(1, dim) if found is None else units(found[1]), bits * tables)
    coded_rows = materialize(coded(vectors, rotations, bits, id_col, vector_col), "codes")
    rows = coded_rows.select("id", "cls")
    classes = coded_rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("dim").alias("dim"), F.any_value("vector").alias("vector"), F.any_value("code").alias("code")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # nodes are numbers of classes: once written, they stay
    bucket, keys = ["t", "dim", "key"], ["t", "dim", "key", "_i", "_j"]
    each = classes.select("node", "dim", "code", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
    members = each.select("node", "dim", "code", "t", F.conv(F.hex(F.substring("code", F.col("t") * 4 + 1, F.lit(4))), 16, 10).cast("long").alias("key"))
    apart = most_apart(threshold, bits * tables)
    active = map_groups(block_pairs(members, bucket, "node", BLOCK).select(*keys, "_b", "node", "code"), keys, lambda t: with_candidates(t, apart), "t int, dim int, key long, node long")
    active = materialize(active.distinct(), "active")
    pairs = block_pairs(active.join(classes.select("node", "code", "vector", "copies"), "node"), bucket, "node", BLOCK).select(*keys, "_b", "node", "code", "vector", "copies")
    links = materialize(map_groups(pairs, keys, lambda t: cosine_links(t, apart, threshold), "a long, b long, n long"), "links")
    release(active)
    counts = links.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    of_class = classes.select("cls", "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    of_class = of_class.select("cls", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    of_root = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(of_root, "root").select("cls", "n_links", "component_id")
    grouped = rows.where("cls IS NOT NULL").join(of_class, "cls").select("id", "n_links", "component_id")
    alone = rows.where("cls IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return grouped.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
