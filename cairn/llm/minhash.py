"""MinHash near-dedup with odd sketches, and exact confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_pairs, forest, forest_of_blocks, map_groups
from .common import components, let_go, materialize, release, small
from .shingles import chunks, mix64, set_key, shingles

#: Bands and rows of a band: a pair at 0.85 shares no band with odds of 8e-7.
BANDS, ROWS = 24, 5
#: Bits of an odd sketch of BANDS * ROWS samples.
BITS = 256
#: Members of a block.
BLOCK = 256
#: Candidates whose sketches put the similarity below the threshold less this many standard deviations of the samples go.
SLACK = 5.0


def _factors() -> np.ndarray:
    return mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS * ROWS samples for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(flat * a, starts) for a in _factors()], axis=1)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """For each row of samples a bitmap of BITS: each (place, sample) turns over one bit."""
    place = np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    bit = (mix64(samples + place) % np.uint64(BITS)).astype(np.int64)
    counts = np.zeros((len(samples), BITS), np.uint8)
    np.add.at(counts, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits(counts & 1, axis=1, bitorder="little")


def most_apart(threshold: float) -> int:
    """The most bits in which the sketches of a pair that may reach the threshold differ.

    The samples' share of agreement at the threshold has a standard deviation of sqrt(t (1-t) / k).
    Turning over d bits at random leaves (1 - (1 - 2/n)**d) n/2 of them set, with fewer than n/2 of variance.
    """
    k = BANDS * ROWS
    low = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / k)
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * k * (1 - low))))


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band of each row of samples."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for r in range(ROWS):
        keys = keys * np.uint64(0xD6E8FEB86659FD93) + samples[:, r::ROWS]
    return mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """A row per row: (id, th, cls, n, bands, sketch). th names the text, cls the shingle set; cls is null for an empty set."""
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")]
            for part in chunks(sizes):
                sets = shingles(batch.column("text").slice(part.start, part.stop - part.start).to_pylist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                cls, bands, sketches = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    samples = minhashes([sets[i] for i in full])
                    for i, keys, sketch in zip(full, band_keys(samples), odd_sketches(samples)):
                        cls[i], bands[i], sketches[i] = set_key(sets[i]), keys, sketch.tobytes()
                here = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [here.column("id"), here.column("th"), pa.array(cls, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["id", "th", "cls", "n", "bands", "sketch"],
                )
        let_go()

    return frame.mapInArrow(run, f"id {kind}, th long, cls binary, n long, bands array<long>, sketch binary")


EDGE = "a long, b long"


def _edges(nodes: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not found:
        return None
    a, b = np.array(found).T
    return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])


def sketch_edges(table: pa.Table, apart: int) -> pa.RecordBatch | None:
    """A forest of the pairs of a pair of blocks whose sketches differ in so many bits at most."""
    nodes = table.column("node").to_numpy()
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(nodes), -1)
    distance = np.zeros((len(nodes), len(nodes)), np.int32)
    for word in bits.T:
        distance += np.bitwise_count(word[:, None] ^ word[None, :])
    linked = distance <= apart
    np.fill_diagonal(linked, False)
    return _edges(nodes, forest_of_blocks(linked, table.column("_b").to_numpy()))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, exactly: products of 0/1 matrices over the hashes that two sets have."""
    names, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    both = count[at] > 1
    column = (np.cumsum(count > 1) - 1)[at[both]]
    row, width = row[both], int((count > 1).sum())
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(sets), min(4096, width - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def exact_edges(table: pa.Table, words: int, percent: int) -> pa.RecordBatch | None:
    """A forest of the pairs of a group with 100 * intersection >= percent * union of full sets. A node may stand in the group twice."""
    texts, names, nodes = table.column("text").to_pylist(), table.column("cls").to_pylist(), table.column("node").to_numpy()
    sets = [s for part in chunks([len(t) for t in texts]) for s in shingles(texts[part], words)]
    right = [i for i, s in enumerate(sets) if len(s) and set_key(s) == names[i]]
    if len(right) < 2:
        return None
    nodes, sets = nodes[right], [sets[i] for i in right]
    both = overlaps(sets)
    size = np.array([len(s) for s in sets], np.float64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    linked &= nodes[:, None] != nodes[None, :]
    return _edges(nodes, forest(linked))


def wanted_here(table: pa.Table, apart: int) -> pa.RecordBatch | None:
    """Which nodes of a task of wanted() have to be compared on full sets in it."""
    some = table.column("some").combine_chunks().to_numpy(zero_copy_only=False)
    if some.all() or not some.any():
        return None
    x, y = table.filter(pa.array(some)), table.filter(pa.array(~some))
    column = lambda t, name: t.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    bits = [np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1) for t in (x, y)]
    distance = np.zeros((x.num_rows, y.num_rows), np.int32)
    for here, there in zip(bits[0].T, bits[1].T):
        distance += np.bitwise_count(here[:, None] ^ there[None, :])
    nodes = [column(t, "node") for t in (x, y)]
    open_ = (distance <= apart) & (column(x, "part")[:, None] != column(y, "part")[None, :])
    open_ &= column(y, "in_main")[None, :] | (nodes[0][:, None] < nodes[1][None, :])
    open_ &= ~(column(x, "told")[:, None] & column(y, "told")[None, :])
    i, j = np.nonzero(open_)
    bands = [np.array(t.column("bands").to_pylist(), np.int64).reshape(t.num_rows, -1) for t in (x, y)]
    same = bands[0][i] == bands[1][j]
    first = same.argmax(axis=1)
    here = bands[0][i, first] == table.column("band")[0].as_py()
    found = np.unique(np.concatenate([nodes[0][i[here]], nodes[1][j[here]]]))
    if not len(found):
        return None
    keys = [pa.array(np.full(len(found), table.column(k)[0].as_py(), np.int64)) for k in ("band", "_p", "_q")]
    return pa.RecordBatch.from_arrays([*keys, pa.array(found)], ["band", "_p", "_q", "node"])


def wanted(nodes: DataFrame, apart: int) -> DataFrame:
    """(band, _p, _q, node): tasks in which candidates of different parts stand together, by nodes (node, part, told, bands, sketch).

    Candidates share a band and have sketches that differ in so many bits at most; those that are both told have been compared before. In a band all members outside
    its largest part meet all its others, in pairs of blocks, and a band of one part has no task. A pair counts in the first band that both
    have only, and a node is given for a task only if it has a candidate there. So texts are fetched in proportion to candidates, however large the group that they chain.
    """
    spread = nodes.select("node", "part", "told", "bands", "sketch", F.explode("bands").alias("band"))
    counts = spread.groupBy("band", "part").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size")).where("most < size")
    others, every = F.ceil((F.col("size") - F.col("most")) / BLOCK), F.ceil(F.col("size") / BLOCK)
    placed = spread.join(sizes, "band").withColumn("in_main", F.col("part") == F.col("main"))
    some = placed.where("not in_main").withColumns({"some": F.lit(True), "_p": F.pmod(F.xxhash64("node"), others), "_q": F.explode(F.sequence(F.lit(0), every - 1))})
    all_of = placed.withColumns({"some": F.lit(False), "_q": F.pmod(F.xxhash64("node"), every), "_p": F.explode(F.sequence(F.lit(0), others - 1))})
    columns = ["band", "_p", "_q", "some", "node", "part", "told", "in_main", "bands", "sketch"]
    return map_groups(some.select(columns).unionByName(all_of.select(columns)), ["band", "_p", "_q"], lambda t: wanted_here(t, apart), "band long, _p long, _q long, node long")


def confirmed_edges(linked: DataFrame, marks: DataFrame, texts: DataFrame, words: int, percent: int) -> list[DataFrame]:
    """Edges (a, b) that join all nodes of each rough component of linked (node, cls, root, id, th) that full sets join. marks: (node, bands, sketch).

    First the nodes of a block are compared with each other, which is all for a component of one block. Of larger ones the parts that this gives are
    then compared by a node each, and only where parts are left over, all nodes with those of other parts: in both cases only
    candidates (wanted). So a large group of copies is not compared pair by pair, nor is a long chain of texts that are nearly alike enough, and no link between candidates is lost.
    """
    apart = most_apart(percent / 100)

    def with_texts(nodes: DataFrame) -> DataFrame:
        """nodes with one text each, whatever the number of rows equal to it."""
        found = texts.join(small(nodes), F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_th") == F.col("th")))
        return found.groupBy("node").agg(F.any_value("text").alias("text"), *[F.any_value(c).alias(c) for c in nodes.columns if c not in ("node", "id", "th")])

    def compare(groups: DataFrame, keys: list[str]) -> DataFrame:
        return map_groups(groups.select(*keys, "node", "cls", "text"), keys, lambda t: exact_edges(t, words, percent), EDGE)

    sized = linked.join(linked.groupBy("root").agg(F.count("*").alias("size")), "root")
    within = sized.withColumn("_b", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
    edges = [materialize(compare(with_texts(within.drop("size")), ["root", "_b"]), "within")]
    large = sized.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return edges

    def parts() -> DataFrame:
        """The nodes of large components with the part that each is in by the edges so far, where there is more than one."""
        of = components(edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])).select("node", F.col("root").alias("part"))
        placed = large.join(of, "node", "left").withColumn("part", F.coalesce("part", "node"))
        many = placed.groupBy("root").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("root")
        return materialize(placed.join(many, "root", "left_semi"), "parts")

    def across(nodes: DataFrame, label: str) -> DataFrame:
        tasks = materialize(wanted(nodes.join(marks, "node"), apart), "wanted")
        few = nodes.join(tasks.select("node").distinct(), "node", "left_semi").select("node", "cls", "id", "th")
        found = materialize(compare(tasks.join(with_texts(few), "node"), ["band", "_p", "_q"]), label)
        release(tasks)
        return found

    before = parts()
    heads = before.where("part = node")
    edges.append(across(heads.withColumn("told", F.lit(False)), "heads"))
    left = parts()
    if not left.isEmpty():
        was = heads.select("node", F.lit(True).alias("told"))
        edges.append(across(left.join(was, "node", "left").withColumn("told", F.coalesce("told", F.lit(False))), "across"))
    release(before, left)
    return edges


def class_components(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of signatures() but for bands and sketches, and for each class its component: (cls, root)."""
    signed = materialize(signatures(docs, id_col, text_col, words), "signatures")
    rows = signed.select("id", "th", "cls", "n")
    classes = signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("id", "th")).alias("first"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # nodes are numbers of classes: once written, they stay
    members = classes.select("node", "sketch", F.explode("bands").alias("band"))
    apart = most_apart(percent / 100)
    candidates = map_groups(block_pairs(members, ["band"], "node", BLOCK).select("band", "_i", "_j", "_b", "node", "sketch"), ["band", "_i", "_j"], lambda t: sketch_edges(t, apart), EDGE)
    rough = components(candidates)
    linked = materialize(rough.join(classes.select("node", "cls", "first"), "node").select("node", "cls", "root", F.col("first.id").alias("id"), F.col("first.th").alias("th")), "linked")
    texts = docs.select(F.col(id_col).alias("t_id"), F.xxhash64(text_col).alias("t_th"), F.col(text_col).cast("binary").alias("text"))
    edges = confirmed_edges(linked, classes.select("node", "bands", "sketch"), texts, words, percent)
    release(linked)
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    links = components(found)
    release(*edges)
    of_class = classes.select("cls", "node").join(links, "node", "left")
    return rows, of_class.select("cls", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components: (id_col, n_shingles, component_id, kept), a row per row of docs.

    Texts with equal sets of word shingles are one class, whatever their number. Classes that share a band of
    MinHash samples are candidates; odd sketches, bitmaps that each sample turns over one bit of, tell by the population count of their XOR which of
    them may reach the threshold. The components of these are compared on full
    sets, recomputed from whole texts (confirmed_edges), and the confirmed links give the components. Large bands are compared in
    blocks and give spanning forests, so that no task holds a group and no stage writes all its pairs; of large components only candidates are.

    A text that is null or has no word has n_shingles 0 and its own id as component_id. Ids may repeat: each row is in its set's
    component. Null ids count for no component's smallest id; component_id is null if a component has no
    other, and kept is then false. Other columns are ignored. No rows give no rows.
    """
    rows, of_class = class_components(docs, percent, words, id_col, text_col)
    full = rows.where("cls IS NOT NULL")
    least = full.groupBy("cls").agg(F.min("id").alias("least")).join(of_class, "cls")
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = least.join(of_root, "root").select("cls", "component_id")
    grouped = full.select("id", "n", "cls").join(ids, "cls").select("id", "n", "component_id")
    alone = rows.where("cls IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate component: that of the smallest id, nulls last, then of the smallest hash of its text.

    Rows with no word stay, null and empty texts among them. Of rows equal in id and text, which are one document, one stays. All columns of docs
    stay as they are, whatever their names.
    """
    rows, of_class = class_components(docs, percent, words, id_col, text_col)
    placed = materialize(rows.where("cls IS NOT NULL").select("id", "th", "cls").join(of_class, "cls").select("root", F.struct(F.col("id").isNull().alias("none"), "id", "th").alias("place")), "placed")
    stays = placed.groupBy("root").agg(F.min("place").alias("stays"))
    gone = placed.join(stays, "root").where("place <> stays").select(F.col("place.id").alias("g_id"), F.col("place.th").alias("g_th")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    match = F.col("id").eqNullSafe(F.col("g_id")) & (F.xxhash64("text") == F.col("g_th"))
    left = whole.join(small(materialize(gone, "gone")), match, "left_anti")
    repeated = not placed.groupBy("place").count().where("count > 1").isEmpty()
    release(placed)
    if repeated:
        full = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        left = left.where(full).dropDuplicates(["id", "text"]).unionByName(left.where(~full))
    return left.select("row.*")
