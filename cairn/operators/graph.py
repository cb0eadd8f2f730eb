"""The entity graph, trees of paths, and reachability."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, stored


def facts_of(facts: DataFrame, edges: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Facts linked to an entity whose name holds the given one, without regard to case."""
    hit = entities.where(F.contains(F.lower("name"), F.lit(name.lower()))).select("entity_id", "name")
    return facts.join(edges.join(hit, "entity_id"), facts.id == edges.fact_id).select(facts.id, "trust_score", "entity_id", "name")


def related(edges: DataFrame, fact_id: int) -> DataFrame:
    """Facts that share an entity with a fact, itself excluded: (fact_id, shared), shared counting the entities."""
    own = edges.where(F.col("fact_id") == fact_id).select("entity_id")
    return edges.join(own, "entity_id").where(F.col("fact_id") != fact_id).groupBy("fact_id").agg(F.count_distinct("entity_id").alias("shared"))


def all_of(facts: DataFrame, edges: DataFrame, entities: DataFrame, names: list[str]) -> DataFrame:
    """Facts linked to every one of the named entities: (id, trust_score, matches)."""
    hit = entities.where(F.col("name").isin(names)).select("entity_id", "name")
    linked = edges.join(hit, "entity_id").groupBy("fact_id").agg(F.count_distinct("name").alias("names"), F.count_distinct("entity_id").alias("matches"))
    return facts.join(linked.where(F.col("names") == len(set(names))), facts.id == linked.fact_id).select("id", "trust_score", "matches")


def entity_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Every entity with the number of its facts, 0 too."""
    counts = edges.groupBy("entity_id").agg(F.count("*").alias("facts"))
    return entities.join(counts, "entity_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0).cast("long")))


def prefixes(paths: DataFrame, path: str = "path", mark: str = "/") -> DataFrame:
    """A row for each proper or whole prefix of each path: paths' columns with node and depth."""
    parts = F.split(path, f"[{mark}]")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), mark).alias("node"), n.alias("depth")))
    return paths.select("*", F.explode(nodes).alias("_n")).select(*paths.columns, "_n.node", "_n.depth")


def subtree(nodes: DataFrame, root: str, path: str = "path") -> DataFrame:
    """A node and all nodes below it."""
    return nodes.where((F.col(path) == root) | F.startswith(F.col(path), F.lit(root + "/")))


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes within so many hops along (src, dst): (node, depth), depth the least. start has node. Each hop joins the new nodes only."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        found = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def hotspots(edges: DataFrame, limit: int) -> DataFrame:
    """The nodes with most edges into them: (node, in_degree)."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "node").limit(limit)


def imported_by(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Which files import each file: (path, imported_by), for files (path) and imports (path, module).

    A module is the file of that name, a/b.py for a.b or a package's __init__; else the first file, by path, above or below it. Files do not import themselves.
    Names above and below meet through their prefixes, so that both are joins on equal keys.
    """
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"[/\\]", "."), r"\.py$", ""), r"\.__init__$", "")
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\.")) - 1), lambda n: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), n), "."))
    proper = lambda c: F.explode(F.when(F.size(F.split(c, r"\.")) > 1, above(c)).otherwise(F.array().cast("array<string>")))
    modules = files.select("path", name.alias("mod"))
    wanted = imports.select("module").distinct()
    exact = wanted.join(modules, F.col("module") == F.col("mod")).select("module", "path", F.lit(0).alias("o"))
    below = modules.select("path", proper(F.col("mod")).alias("module")).join(wanted, "module").select("module", "path", F.lit(1).alias("o"))
    over = wanted.select("module", proper(F.col("module")).alias("mod")).join(modules, "mod").select("module", "path", F.lit(1).alias("o"))
    target = exact.unionByName(below).unionByName(over).groupBy("module").agg(F.min(F.struct("o", "path")).alias("t")).select("module", F.col("t.path").alias("target"))
    return imports.join(target, "module").where("path <> target").select(F.col("target").alias("path"), F.col("path").alias("imported_by")).distinct()


def add_nodes(tree: DataFrame, new: DataFrame, mark: str = "/") -> DataFrame:
    """tree (path, depth, label) with new nodes (path, label): one below its parent's depth, or at 0 without one; a known path takes the new label. Parents may be new too, if they are of the same batch."""
    named = new.groupBy("path").agg(F.max("label").alias("label"))
    # The depth of a node in the batch: its place below the nearest ancestor in the tree, through ancestors that are all in the batch.
    ups = prefixes(named.select("path"), "path", mark).where("node <> path")
    anchored = ups.join(tree.select(F.col("path").alias("node"), F.col("depth").alias("d")), "node").groupBy("path").agg(F.max_by(F.struct("depth", "d"), "depth").alias("a"))
    missing = ups.join(anchored.select("path", F.col("a.depth").alias("from")), "path", "left").where(F.col("depth") > F.coalesce("from", F.lit(0)))
    broken = missing.join(named.select(F.col("path").alias("node")), "node", "left_anti").groupBy("path").agg(F.max("depth").alias("gap"))
    levels = F.size(F.split("path", f"[{mark}]"))
    depth = F.when(F.col("gap").isNotNull(), levels - F.col("gap") - 1).when(F.col("a").isNotNull(), F.col("a.d") + levels - F.col("a.depth")).otherwise(levels - 1)
    fresh = named.join(anchored, "path", "left").join(broken, "path", "left").select("path", depth.cast("int").alias("depth"), "label")
    kept = tree.join(named.select("path", F.col("label").alias("_l")), "path", "left").select("path", "depth", F.coalesce("_l", "label").alias("label"))
    return kept.unionByName(fresh.join(tree.select("path"), "path", "left_anti"))


def link_entities(facts: DataFrame, known: DataFrame, names) -> tuple[DataFrame, DataFrame]:
    """Entities that facts (id, fact_value) name, by names, a function from the value's column to an array: new ones (name), not known (name) in any case, and edges (fact_id, name), once each.

    An entity is written as in the fact of least id, where it stands first. A fact may give a name many times. Facts are read once: what they name is a table in the shared folder.
    """
    named = facts.select("id", F.posexplode(names(F.col("fact_value"))).alias("at", "name"))
    found = stored(named.groupBy("id", F.lower("name").alias("low")).agg(F.min(F.struct("at", "name")).alias("first")), "named")
    written = found.groupBy("low").agg(F.min_by("first.name", F.struct("id", "first.at")).alias("name"))
    new = written.join(known.select(F.lower("name").alias("low")).distinct(), "low", "left_anti").select("name")
    return new, found.join(written, "low").select(F.col("id").alias("fact_id"), "name")


def _cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the session's checkpoint folder, which survives lost executors. Only a session whose tasks all run in this process gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(neighbours: DataFrame | Callable[[DataFrame], DataFrame], start: DataFrame, hops: int, branch: int, least: float, most: float) -> DataFrame:
    """Spreading recall: from each start (seed, node) to its best `branch` neighbours (src, dst, score) with least <= score <= most, hop by hop, no node twice for a seed.

    neighbours is a table of all of them, or a function that makes those of the distinct nodes (node) that a hop has reached anew.
    """
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    best_of = lambda near: near.where(F.col("score").between(least, most)).withColumn("_rn", rank).where(F.col("_rn") <= branch).select("src", "dst")
    best = None if callable(neighbours) else best_of(neighbours)
    levels, known = [start.select("seed", "node").withColumn("depth", F.lit(0))], None
    for hop in range(1, hops + 1):
        seen = reduce(DataFrame.unionByName, levels).select("seed", "node")
        if callable(neighbours):
            nodes = levels[-1].select("node").distinct()
            if known is not None:
                nodes = nodes.join(known.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
            new = _cut(best_of(neighbours(_cut(nodes))))
            best = known = new if known is None else known.unionByName(new)
        found = levels[-1].join(best, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        found = found.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(hop))
        levels.append(_cut(found) if callable(neighbours) else found)
    return reduce(DataFrame.unionByName, levels)
