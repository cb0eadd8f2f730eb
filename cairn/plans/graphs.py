"""Graph and tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, recall
from ..sources.tables import relation, table
from .registry import query

G = ("entities", "fact_entities", "order_facts")
EDGES_SQL = "SELECT p_partkey AS src, (7 * p_partkey + 3) % (SELECT count(*) FROM part) AS dst FROM part UNION ALL SELECT p_partkey, (11 * p_partkey + 5) % (SELECT count(*) FROM part) FROM part"
PATHS_SQL = "SELECT concat(r_name, '/', n_name) AS path, count(c_custkey) AS facts FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"


def imports(spark: SparkSession, folder: str) -> DataFrame:
    """A graph on the parts: two edges from each."""
    part = table(spark, folder, "part")
    n = part.count()
    to = F.explode(F.array((7 * F.col("p_partkey") + 3) % n, (11 * F.col("p_partkey") + 5) % n))
    return part.select(F.col("p_partkey").alias("src"), to.alias("dst"))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """A path region/nation for each nation, with its number of customers."""
    customers = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("facts"))
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(customers, "n_nationkey", "left")
    return nations.select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.coalesce("facts", F.lit(0)).alias("facts"))


@query("SELECT fe.entity_id, e.name, e.entity_type FROM fact_entities fe JOIN entities e USING (entity_id) WHERE fact_id = 1", *G)
def e1_entities_of_fact(spark: SparkSession, folder: str) -> DataFrame:
    edges = relation(spark, folder, "fact_entities").where("fact_id = 1")
    return edges.join(relation(spark, folder, "entities"), "entity_id").select("entity_id", "name", "entity_type")


@query("SELECT f.id, f.trust_score, e.entity_id, e.name FROM order_facts f JOIN fact_entities fe ON fe.fact_id = f.id JOIN entities e USING (entity_id) WHERE contains(lower(e.name), 'brand#1')", *G)
def e2_facts_of_entity(spark: SparkSession, folder: str) -> DataFrame:
    return graph.facts_of(*(relation(spark, folder, n) for n in ("order_facts", "fact_entities", "entities")), "Brand#1")


@query("SELECT o.fact_id, count(DISTINCT o.entity_id) AS shared FROM fact_entities f JOIN fact_entities o USING (entity_id) WHERE f.fact_id = 1 AND o.fact_id <> 1 GROUP BY o.fact_id", *G)
def e3_related_facts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.related(relation(spark, folder, "fact_entities"), 1)


@query(
    """SELECT f.id, f.trust_score, matches FROM order_facts f JOIN (SELECT fact_id, count(DISTINCT entity_id) AS matches FROM fact_entities JOIN entities USING (entity_id)
 WHERE name IN ('Brand#11', 'Brand#12') GROUP BY fact_id HAVING count(DISTINCT name) = 2) m ON m.fact_id = f.id""",
    *G,
)
def e4_facts_with_all(spark: SparkSession, folder: str) -> DataFrame:
    return graph.all_of(*(relation(spark, folder, n) for n in ("order_facts", "fact_entities", "entities")), ["Brand#11", "Brand#12"])


@query("SELECT e.entity_id, e.name, count(fe.fact_id) AS facts FROM entities e LEFT JOIN fact_entities fe USING (entity_id) GROUP BY e.entity_id, e.name", *G)
def e5_entity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.entity_counts(relation(spark, folder, "entities"), relation(spark, folder, "fact_entities")).select("entity_id", "name", "facts")


@query(f"SELECT path, facts FROM ({PATHS_SQL}) t WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')")
def e9_subtree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.subtree(tree(spark, folder), "ASIA")


@query(f"SELECT path, split_part(path, '/', 1) AS node, CAST(1 AS INT) AS depth FROM ({PATHS_SQL}) t UNION ALL SELECT path, path, CAST(2 AS INT) FROM ({PATHS_SQL}) t")
def e10_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return graph.prefixes(tree(spark, folder)).select("path", "node", "depth")


@query(f"SELECT node, CAST(sum(facts) AS BIGINT) AS facts FROM (SELECT split_part(path, '/', 1) AS node, facts FROM ({PATHS_SQL}) t UNION ALL SELECT path, facts FROM ({PATHS_SQL}) t) u GROUP BY node")
def e12_knowledge_tree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.prefixes(tree(spark, folder)).groupBy("node").agg(F.sum("facts").alias("facts"))


@query(
    f"""WITH RECURSIVE edges AS ({EDGES_SQL}), walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
 SELECT node, min(depth) AS depth FROM walk GROUP BY node"""
)
def e14_blast_radius(spark: SparkSession, folder: str) -> DataFrame:
    start = table(spark, folder, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    return graph.reach(imports(spark, folder), start, 3)


@query(f"SELECT dst AS node, count(*) AS in_degree FROM ({EDGES_SQL}) e GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10")
def e15_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return graph.hotspots(imports(spark, folder), 10)


@query(
    """SELECT a.agent, coalesce(n, 0) AS facts FROM (SELECT DISTINCT coalesce(agent_id, 'local') AS agent FROM facts UNION SELECT 'agent_idle') a LEFT JOIN
 (SELECT coalesce(agent_id, 'local') AS agent, count(*) AS n FROM facts WHERE archived = 0 GROUP BY 1) c USING (agent)""",
    "facts",
)
def e7_agents(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").withColumn("agent", F.coalesce("agent_id", F.lit("local")))
    agents = facts.select("agent").unionByName(spark.sql("SELECT 'agent_idle' AS agent")).distinct()
    counts = facts.where("archived = 0").groupBy("agent").agg(F.count("*").alias("facts"))
    return agents.join(counts, "agent", "left").select("agent", F.coalesce("facts", F.lit(0)).alias("facts"))


@query()
def d23_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Spreading recall from every vector of an id divisible by 50, over nearest neighbours of the nodes that each hop reaches; tested against a plain loop."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")

    def near(nodes: DataFrame) -> DataFrame:
        queries = vectors.join(nodes, F.col("vec_id") == F.col("node")).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
        return recall.vector_topk(vectors, queries, 6).select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), "score")

    start = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("seed"), F.col("vec_id").alias("node"))
    return graph.spread(near, start, 3, 3, 0.2, 0.9)


FILES_SQL = "SELECT c_custkey AS k, concat('m', CAST(c_nationkey AS VARCHAR), '/f', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 9 = 0 THEN '/__init__.py' ELSE '.py' END) AS path FROM customer"


@query(
    f"""WITH f AS (SELECT k, path, regexp_replace(regexp_replace(replace(path, '/', '.'), '\\.py$', ''), '\\.__init__$', '') AS mod FROM ({FILES_SQL}) x),
 i AS (SELECT a.path, CASE a.k % 4 WHEN 0 THEN b.mod WHEN 1 THEN concat(b.mod, '.part') WHEN 2 THEN split_part(b.mod, '.', 1) ELSE 'os.path' END AS module FROM f a JOIN f b ON b.k = a.k + 1),
 w AS (SELECT DISTINCT module FROM i), t AS (SELECT module, arg_min(path, (o, path)) AS target FROM (SELECT module, path, 0 AS o FROM w JOIN f ON mod = module UNION ALL SELECT module, path, 1 FROM w JOIN f ON starts_with(mod, concat(module, '.')) OR starts_with(module, concat(mod, '.'))) u GROUP BY module)
 SELECT DISTINCT target AS path, i.path AS imported_by FROM i JOIN t USING (module) WHERE target <> i.path"""
)
def e13_imported_by(spark: SparkSession, folder: str) -> DataFrame:
    """Files that import the file after them by name, by something within it, or by its folder."""
    end = F.when(F.col("c_custkey") % 9 == 0, "/__init__.py").otherwise(".py")
    path = F.concat(F.lit("m"), F.col("c_nationkey").cast("string"), F.lit("/f"), F.col("c_custkey").cast("string"), end)
    files = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), path.alias("path"))
    mod = F.regexp_replace(F.regexp_replace(F.replace("path", F.lit("/"), F.lit(".")), r"\.py$", ""), r"\.__init__$", "")
    after = files.select((F.col("k") - 1).alias("k"), mod.alias("mod"))
    module = F.when(F.col("k") % 4 == 0, F.col("mod")).when(F.col("k") % 4 == 1, F.concat("mod", F.lit(".part"))).when(F.col("k") % 4 == 2, F.substring_index("mod", ".", 1)).otherwise("os.path")
    imports = files.join(after, "k").select("path", module.alias("module"))
    return graph.imported_by(files.select("path"), imports)
