"""The remaining small operators: dates in text, gates, banks, blocks, queues, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from ..operators import graph, lifecycle, pairs, recall, writes
from ..sources.tables import AS_OF, DAY, relation, table
from ..streaming.coalesce import PROFILES
from .lifecycle import HEAT, HEAT_AS_OF, SQL_LANES, heat
from .filters import SQL_LINES
from .registry import query
from .textual import SQL_JACCARD, SQL_WORDS, sql_grams


@query("SELECT id FROM facts WHERE coalesce(agent_id = 'agent_b' OR category = 'agent_b', false) AND archived = 0", "facts")
def b2_visible(spark: SparkSession, folder: str) -> DataFrame:
    """What a tenant sees when tenants are strictly apart."""
    facts = relation(spark, folder, "facts").where("archived = 0")
    return facts.where(rules.tenant("agent_b", F.col("agent_id"), F.col("category"), strict=True)).select("id")


SQL_ISO = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S')"
TRACE_KEYS = 7


@query(
    f"""SELECT id, t FROM (SELECT id, coalesce({", ".join(f"CAST(epoch(TRY_CAST(k{k} AS TIMESTAMP)) AS BIGINT)" for k in range(TRACE_KEYS))}, 0) AS t FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'soon' END AS k0, NULL AS k1, CASE WHEN id % 3 = 0 THEN {SQL_ISO.format('recorded_s')} END AS k2,
 CASE WHEN id % 5 = 0 THEN '2024-04-31' END AS k3, {SQL_ISO.format('valid_from_s')} AS k4, {SQL_ISO.format('valid_to_s')} AS k5, CASE WHEN id % 4 = 1 THEN '2024-05-06' END AS k6 FROM facts) a) b WHERE t >= 1709251200 AND t < 1727740800""",
    "facts",
)
def b7_trace_window(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by the first of seven keys that can be read as a time."""
    i, iso = F.col("id"), lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss")
    keys = [F.when(i % 2 == 0, "soon"), F.lit(None).cast("string"), F.when(i % 3 == 0, iso("recorded_s")), F.when(i % 5 == 0, "2024-04-31"), iso("valid_from_s"), iso("valid_to_s"), F.when(i % 4 == 1, "2024-05-06")]
    found = relation(spark, folder, "facts").select("id", text.first_time(*keys).alias("t"))
    return found.where("t >= 1709251200 AND t < 1727740800")


SQL_DATES = "list_transform(list_zip(regexp_extract_all(v, '{d}', 1), regexp_extract_all(v, '{d}', 2), regexp_extract_all(v, '{d}', 3)), lambda z: TRY_CAST(concat(z[1], '-', lpad(z[2], 2, '0'), '-', lpad(CASE WHEN coalesce(z[3], '') = '' THEN '1' ELSE z[3] END, 2, '0')) AS DATE))".format(d=text.DATE)


@query(
    f"""SELECT id, CAST(CASE WHEN since AND (until IS NULL OR d[1] <> until) THEN d[1] END AS VARCHAR) AS valid_from, CAST(until AS VARCHAR) AS valid_to FROM (SELECT id, d, regexp_matches(lower(v), '{"|".join(text.SINCE_WORDS)}') AS since,
 CASE WHEN regexp_matches(lower(v), '{"|".join(text.UNTIL_WORDS)}') THEN list_filter(d, lambda x: x IS NOT NULL)[-1] END AS until FROM (SELECT id, v, {SQL_DATES} AS d FROM
 (SELECT id, concat(CASE id % 4 WHEN 0 THEN concat('effective 2024-02-', CAST(id % 31 + 1 AS VARCHAR), ' ') WHEN 1 THEN '自2024年3月起 ' ELSE '' END, fact_value, CASE id % 3 WHEN 0 THEN ' expires 2025.3.4' WHEN 1 THEN ' 2025-13-40' ELSE concat(' 有效期至2025/0', CAST(id % 9 + 1 AS VARCHAR)) END) AS v FROM facts) a) b) c
 WHERE until IS NOT NULL OR since""",
    "facts",
)
def b14_validity(spark: SparkSession, folder: str) -> DataFrame:
    """When facts say that they hold, among whole values with dates written around them."""
    i = F.col("id")
    before = F.when(i % 4 == 0, F.concat(F.lit("effective 2024-02-"), (i % 31 + 1).cast("string"), F.lit(" "))).when(i % 4 == 1, "自2024年3月起 ").otherwise("")
    after = F.when(i % 3 == 0, " expires 2025.3.4").when(i % 3 == 1, " 2025-13-40").otherwise(F.concat(F.lit(" 有效期至2025/0"), (i % 9 + 1).cast("string")))
    rows = relation(spark, folder, "facts").select("id", F.concat(before, "fact_value", after).alias("v"))
    found = rows.select("id", "v", text.validity(F.col("v")).alias("x"))
    held = F.col("x.valid_to").isNotNull() | F.lower("v").rlike("|".join(text.SINCE_WORDS))
    return found.where(held).select("id", F.col("x.valid_from").cast("string").alias("valid_from"), F.col("x.valid_to").cast("string").alias("valid_to"))


@query(f"SELECT session_id, turn, regexp_matches(concat(content, CASE turn % 3 WHEN 0 THEN ' 生日是哪天' ELSE '' END), '{rules.FACT_SEEKING}') AS seeks FROM turns", "turns")
def b17_fact_seeking(spark: SparkSession, folder: str) -> DataFrame:
    """Every third turn ends in a question for a date."""
    said = F.concat("content", F.when(F.col("turn") % 3 == 0, " 生日是哪天").otherwise(""))
    return relation(spark, folder, "turns").select("session_id", "turn", rules.seeks_facts(said).alias("seeks"))


SQL_PROFILE = f"""CASE WHEN id % 8 = 0 THEN 'tech' WHEN id % 8 = 1 THEN 'intimate' WHEN id % 8 = 2 THEN 'default' WHEN id % 8 = 3 THEN 'tech' WHEN category = 'src1' THEN 'intimate' WHEN profile = 'team_b' THEN 'tech' ELSE 'default' END"""


def profile_of_fact() -> Column:
    i = F.col("id")
    asked = F.when(i % 8 == 0, " Dev").when(i % 8 == 1, "love").when(i % 8 == 2, "unknown").when(i % 8 == 3, "tech")
    return rules.coalesce_profile(asked, F.col("category"), F.col("profile"), {"Src1": "intimate"}, {"team_b": "tech"})


@query(f"SELECT id, {SQL_PROFILE} AS profile FROM facts", "facts")
def b21_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """By name or alias, else by category, else by source."""
    return relation(spark, folder, "facts").select("id", profile_of_fact().alias("profile"))


@query(f"SELECT id, recorded_s < {AS_OF} - 30 * 86400 AS unverified FROM facts WHERE memory_tier = 'procedural'", "facts")
def b23_unverified(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").where("memory_tier = 'procedural'").select("id", (F.col("recorded_s") < AS_OF - 30 * DAY).alias("unverified"))


@query(f"SELECT id, CAST(len(list_distinct(list_concat({sql_grams('v', 2)}, {SQL_WORDS.format('v')}))) AS BIGINT) AS tokens FROM (SELECT id, lower(trim(fact_value)) AS v FROM facts) t", "facts")
def c2_tokens(spark: SparkSession, folder: str) -> DataFrame:
    of_two, others = text.gram_sets(F.col("fact_value"))
    return relation(spark, folder, "facts").select("id", (F.size(of_two) + F.size(others)).cast("long").alias("tokens"))


@query("SELECT p_partkey, len(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), lambda t: length(t) < 3)) = 0 AS authoritative FROM part")
def c9_authoritative(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all of a query's terms, here a part's name, are long enough for an empty answer from the index to be final."""
    terms = text.matches(F.lower("p_name"), "[a-z0-9_]+")
    return table(spark, folder, "part").select("p_partkey", F.forall(terms, lambda t: F.length(t) >= 3).alias("authoritative"))


@query(
    """SELECT session_id, turn, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 32), ' ') AS terms FROM
 (SELECT session_id, turn, list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda t: length(t) >= 2) AS l FROM turns) t""",
    "turns",
)
def c10_gate_terms(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "turns").select("session_id", "turn", F.array_join(text.gate_terms(F.col("content")), " ").alias("terms"))


@query(
    "SELECT id, round(least(1E0, 0.8E0 * n / 4E0 + least(n / 10E0, 0.2E0)), 6) AS score FROM (SELECT id, len(list_filter(['the', 'and', 'license', 'of'], lambda t: list_contains(regexp_extract_all(lower(fact_value), '[a-z0-9]+'), t))) AS n FROM facts) t", "facts"
)
def c13_persona_score(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").select("id", F.round(text.persona_score(F.lit("the and license of"), F.col("fact_value")), 6).alias("score"))


@query("""SELECT page_id, CAST(len(list_distinct(list_transform(list_filter(n, lambda x: trim(x) <> ''), lambda x: lower(trim(x))))) AS BIGINT) AS names FROM
 (SELECT page_id, list_concat(regexp_extract_all(html, '["\\\\'']([^"\\\\'']+)["\\\\'']', 1), regexp_extract_all(html, '[A-Z][a-z]+ly')) AS n FROM pages) t""")
def c17_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted names and those of a vocabulary, each once whatever its case."""
    return table(spark, folder, "pages").select("page_id", F.size(text.entities(F.col("html"), ["[A-Z][a-z]+ly"])).cast("long").alias("names"))


@query("SELECT id, regexp_matches(fact_value, '(?i)^the|nd of ') AS found FROM facts", "facts")
def c19_regexp(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").select("id", F.coalesce(F.col("fact_value").rlike("(?i)^the|nd of "), F.lit(False)).alias("found"))


@query(
    "SELECT id, coalesce(epoch(TRY_CAST(a AS TIMESTAMP)), epoch(TRY_CAST(b AS TIMESTAMP)), epoch(TRY_CAST(c AS TIMESTAMP)), 0)::BIGINT AS at_s FROM (SELECT id, CASE WHEN id % 2 = 0 THEN '2024-01-02 bad' END AS a, CASE WHEN id % 3 = 0 THEN '2024-02-03 04:05:06' END AS b, CASE WHEN id % 5 = 0 THEN '2024-06-07' END AS c FROM facts) t",
    "facts",
)
def c20_first_time(spark: SparkSession, folder: str) -> DataFrame:
    """The first of several keys that can be read as a time; 0 without one."""
    i = F.col("id")
    keys = [F.when(i % 2 == 0, "2024-01-02 bad"), F.when(i % 3 == 0, "2024-02-03 04:05:06"), F.when(i % 5 == 0, "2024-06-07")]
    return relation(spark, folder, "facts").select("id", text.first_time(*keys).alias("at_s"))


@query(
    f"""WITH r AS (SELECT id, fact_value, {SQL_WORDS.format('fact_value')} AS w FROM facts WHERE category = 'src5' ORDER BY trust_score DESC, id LIMIT 8)
 SELECT a.id, b.id AS other, round(CASE WHEN a.id = b.id THEN 1E0 ELSE {SQL_JACCARD.format('a.w', 'b.w')} END, 3) AS similarity FROM r a, r b""",
    "facts",
)
def d25_report(spark: SparkSession, folder: str) -> DataFrame:
    """The similarities among the eight best facts: one short list, joined on its category."""
    top = relation(spark, folder, "facts").where("category = 'src5'").orderBy(F.desc("trust_score"), "id").limit(8).select("id", "category", text.words(F.col("fact_value")).alias("w"))
    a, b = top.alias("a"), top.alias("b")
    same = F.when(F.col("a.id") == F.col("b.id"), 1.0).otherwise(text.jaccard(F.col("a.w"), F.col("b.w")))
    return a.join(b, F.col("a.category") == F.col("b.category")).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.round(same, 3).alias("similarity"))


SQL_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
SQL_SOME = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


SQL_EVOLUTION = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT a.vec_id AS new_id, b.vec_id AS old_id, {SQL_COS.format('a.e', 'b.e')} / (sqrt({SQL_COS.format('a.e', 'a.e')}) * sqrt({SQL_COS.format('b.e', 'b.e')})) AS s
 FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY s DESC, old_id) AS rn FROM q) x WHERE rn <= 5),
 p AS (SELECT old_id, new_id, o.text AS old_text, n.text AS new_text FROM k JOIN documents o ON o.doc_id = old_id JOIN documents n ON n.doc_id = new_id WHERE o.text <> ''),
 g AS (SELECT *, {sql_grams('lower(trim(old_text))', 2)} AS og, {sql_grams('lower(trim(new_text))', 2)} AS ng, {SQL_WORDS.format('trim(old_text)')} AS ow, {SQL_WORDS.format('trim(new_text)')} AS nw FROM p),
 j AS (SELECT *, {SQL_JACCARD.format('list_distinct(list_concat(og, ow))', 'list_distinct(list_concat(ng, nw))')} AS similarity FROM g)
 SELECT old_id, new_id, CASE WHEN {SQL_SOME('new_text', pairs.REPLACES)} OR ({SQL_SOME('lower(old_text)', pairs.FOR)} AND {SQL_SOME('lower(new_text)', pairs.AGAINST)}) OR ({SQL_SOME('lower(old_text)', pairs.AGAINST)} AND {SQL_SOME('lower(new_text)', pairs.FOR)})
 THEN 'replaces' ELSE 'enriches' END AS relation, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.12E0"""


@query(SQL_EVOLUTION)
def e16_evolution_edges(spark: SparkSession, folder: str) -> DataFrame:
    """How documents of an id divisible by 50 change their five nearest ones, by the vectors of the same id."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    near = recall.vector_topk(vectors, queries, 5).select(F.col("qid").alias("new_id"), F.col("vec_id").alias("old_id"))
    text_of = lambda side: table(spark, folder, "documents").select(F.col("doc_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
    found = pairs.evolution(near.join(text_of("new"), "new_id").join(text_of("old"), "old_id"))
    return found.select("old_id", "new_id", "relation", F.round("similarity", 6).alias("similarity"))


@query(
    """SELECT path, depth, label FROM (SELECT r_name AS path, 0 AS depth, CASE WHEN r_name = 'ASIA' THEN 'renamed' ELSE 'root' END AS label FROM region
 UNION ALL SELECT concat(r_name, '/', n_name), 1, 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT concat('LOST/x/', n_name), 0, 'far' FROM nation WHERE n_nationkey % 5 = 0) t"""
)
def e11_add_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nations below their regions; a region that gets a new label; nodes below a parent that is nowhere are roots."""
    regions, nations = table(spark, folder, "region"), table(spark, folder, "nation")
    tree = regions.select(F.col("r_name").alias("path"), F.lit(0).alias("depth"), F.lit("root").alias("label"))
    below = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit("nation").alias("label"))
    far = nations.where("n_nationkey % 5 = 0").select(F.concat(F.lit("LOST/x/"), "n_name").alias("path"), F.lit("far").alias("label"))
    return graph.add_nodes(tree, below.unionByName(far).unionByName(spark.sql("SELECT 'ASIA' AS path, 'renamed' AS label")))


@query("SELECT id, category FROM facts WHERE id % 4 = 1 ORDER BY id DESC LIMIT 500", "facts")
def f11_list_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").where("id % 4 = 1").orderBy(F.desc("id")).limit(500).select("id", "category")


@query(
    """WITH s AS (SELECT user_id AS agent_id, session_id * 1000 + turn AS seq, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS role, ts_s, CASE WHEN session_id % 4 = 0 THEN 'deactivate' ELSE 'heartbeat' END AS event FROM turns),
 l AS (SELECT agent_id, arg_max(role, seq) FILTER (WHERE role <> '') AS r, max(ts_s) AS t, arg_max(event, seq) AS e FROM s GROUP BY agent_id),
 a AS (SELECT 'u1' AS agent_id, 'planner' AS role, 4000000000 AS last_seen_s, 1 AS active UNION ALL SELECT 'quiet', 'critic', 5, 1)
 SELECT coalesce(a.agent_id, l.agent_id) AS agent_id, coalesce(r, role) AS role, CAST(greatest(coalesce(last_seen_s, 0), coalesce(t, 0)) AS BIGINT) AS last_seen_s, CASE WHEN e IS NULL THEN active WHEN e = 'deactivate' THEN 0 ELSE 1 END AS active FROM a FULL JOIN l ON a.agent_id = l.agent_id""",
    "turns",
)
def f15_heartbeat(spark: SparkSession, folder: str) -> DataFrame:
    """Agents after what they sent: an empty role leaves the old one, and the last event tells whether they are active."""
    turns = relation(spark, folder, "turns")
    seen = turns.select(F.col("user_id").alias("agent_id"), (F.col("session_id") * 1000 + F.col("turn")).alias("seq"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("role"), "ts_s", F.when(F.col("session_id") % 4 == 0, "deactivate").otherwise("heartbeat").alias("event"))
    agents = spark.sql("SELECT * FROM VALUES ('u1', 'planner', 4000000000L, 1), ('quiet', 'critic', 5L, 1) t(agent_id, role, last_seen_s, active)")
    return lifecycle.touch_agents(agents, seen)


SQL_BANKS = """WITH o AS (SELECT 'src0' AS bank, 1 AS version, CAST(9 AS BIGINT) AS items, 'superseded' AS state UNION ALL SELECT 'src0', 2, 9, 'ready' UNION ALL SELECT 'kept', 1, 4, 'ready'),
 n AS (SELECT category AS bank, least(count(*), 40) AS items FROM facts WHERE agent_id IS NOT NULL GROUP BY category),
 b AS (SELECT bank, version, items, CASE WHEN state = 'ready' AND bank IN (SELECT bank FROM n) THEN 'superseded' ELSE state END AS state FROM o
 UNION ALL SELECT bank, CAST(coalesce((SELECT max(version) FROM o WHERE o.bank = n.bank), 0) + 1 AS INT), items, 'ready' FROM n)"""


def banks(spark: SparkSession, folder: str) -> DataFrame:
    old = spark.sql("SELECT * FROM VALUES ('src0', 1, 9L, 'superseded'), ('src0', 2, 9L, 'ready'), ('kept', 1, 4L, 'ready') t(bank, version, items, state)")
    refs = F.when(F.col("agent_id").isNotNull(), F.array("agent_id"))
    items = relation(spark, folder, "facts").select(F.col("category").alias("bank"), F.col("id").alias("item_id"), F.col("fact_value").alias("content"), refs.alias("refs"))
    return lifecycle.build_banks(items, old, 40)[0]


@query(f"{SQL_BANKS} SELECT bank, version, CAST(items AS BIGINT) AS items, state FROM b", "facts")
def f18_banks(spark: SparkSession, folder: str) -> DataFrame:
    """New bank versions of grounded items; what was ready before is superseded."""
    return banks(spark, folder)


@query(f"{SQL_BANKS} SELECT bank, version, CASE WHEN bank <> 'src0' THEN state WHEN version = 2 THEN 'ready' WHEN state = 'ready' THEN 'superseded' ELSE state END AS state FROM b", "facts")
def f18_roll_back(spark: SparkSession, folder: str) -> DataFrame:
    """One bank back at its second version, and one asked for a version that it never had."""
    wanted = spark.sql("SELECT * FROM VALUES ('src0', 2), ('kept', 7) t(bank, version)")
    return lifecycle.roll_back_banks(banks(spark, folder), wanted).select("bank", "version", "state")


@query(
    f"""WITH n AS (SELECT id, CASE id % 3 WHEN 0 THEN 'u4' WHEN 1 THEN 'u5' ELSE 'default' END AS user_id, trim(fact_value) AS content, id % 40 / 20E0 AS confidence FROM facts WHERE id % 2 = 1),
 o AS (SELECT CASE id % 4 WHEN 0 THEN 'default' WHEN 2 THEN 'u5' END AS user_id, trim(fact_value) AS content FROM facts WHERE id % 2 = 0 UNION ALL SELECT 'default', content FROM n WHERE length(content) % 3 = 0),
 x AS (SELECT id, user_id, confidence, regexp_replace(substring(content, 1, {rules.MOST_CHARS}), '{rules.CONTROLS}', '', 'g') AS t FROM n WHERE content <> ''),
 l AS (SELECT id, max(k) AS most, CAST(sum(k) AS BIGINT) AS lines FROM (SELECT id, y, count(*) AS k FROM (SELECT id, unnest({SQL_LINES}) AS y FROM x) u GROUP BY id, y) g GROUP BY id),
 c AS (SELECT user_id, t AS content, max(least(confidence, 1E0)) AS confidence FROM x LEFT JOIN l USING (id) WHERE NOT regexp_matches(t, '{rules.INJECTION}') AND NOT regexp_matches(lower(regexp_replace(t, '[^0-9a-zA-Z一-鿿]', '', 'g')), '{rules.INJECTION_BARE}')
 AND NOT coalesce(lines > 6 AND most >= 3 AND most / lines > 0.3E0, false) GROUP BY user_id, t)
 SELECT user_id, sha256(content) AS content_hash, round(confidence, 6) AS confidence FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.content = c.content AND (o.user_id = c.user_id OR (c.user_id = 'u4' AND o.user_id = 'default')))""",
    "facts",
)
def f20_save_insights(spark: SparkSession, folder: str) -> DataFrame:
    """New insights that aren't stored yet; the default user, here u4, was once called 'default'."""
    i = F.col("id")
    facts = relation(spark, folder, "facts").withColumn("content", F.trim("fact_value"))
    new = facts.where("id % 2 = 1").select(F.when(i % 3 == 0, "u4").when(i % 3 == 1, "u5").otherwise("default").alias("user_id"), "content", (i % 40 / 20).alias("confidence"))
    old = facts.where("id % 2 = 0").select(F.when(i % 4 == 0, "default").when(i % 4 == 2, "u5").alias("user_id"), "content")
    old = old.unionByName(new.where("length(content) % 3 = 0").select(F.lit("default").alias("user_id"), "content"))
    return writes.save_insights(new, old, "u4").select("user_id", F.sha2("content", 256).alias("content_hash"), F.round("confidence", 6).alias("confidence"))


@query("SELECT id, 0.5E0 AS salience, CAST(0 AS BIGINT) AS access_count, substring(fact_value, 1, 200) AS preview FROM facts WHERE archived = 0", "facts")
def g1_register(spark: SparkSession, folder: str) -> DataFrame:
    rows = relation(spark, folder, "facts").where("archived = 0")
    return rows.select("id", F.lit(0.5).alias("salience"), F.lit(0).cast("long").alias("access_count"), F.substring("fact_value", 1, 200).alias("preview"))


@query("SELECT concat('u', CAST(c_custkey AS VARCHAR), ':', k) AS memory_id, coalesce(s.salience, 0.5E0) AS salience FROM customer CROSS JOIN (VALUES ('view'), ('click')) v(k) LEFT JOIN salience s ON s.memory_id = concat('u', CAST(c_custkey AS VARCHAR), ':', k)", "salience")
def g4_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Heat of a batch of memories, two for each customer; unknown ones have the default."""
    wanted = table(spark, folder, "customer").select(F.explode(F.array(*[F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit(f":{k}")) for k in ("view", "click")])).alias("memory_id"))
    return wanted.join(relation(spark, folder, "salience").select("memory_id", "salience"), "memory_id", "left").select("memory_id", F.coalesce("salience", F.lit(0.5)).alias("salience"))


@query(
    f"""SELECT memory_id, CASE WHEN logged THEN 1E0 ELSE round(least(1E0, salience + 0.05E0), 6) END AS salience, CASE WHEN logged THEN 'lesson' ELSE 'knowledge' END AS lane FROM
 (SELECT h.*, split_part(memory_id, ':', 1) IN (SELECT concat('u', CAST(user_id AS VARCHAR)) FROM events WHERE event_type = 'error' AND value > 60) AS logged FROM {HEAT} WHERE lane = 'lesson') t""",
    "salience",
)
def g21_lessons(spark: SparkSession, folder: str) -> DataFrame:
    """Lessons whose keyword, here the user, is still in the error log stay hot; others become knowledge."""
    rows = heat(spark, folder).withColumn("keyword", F.substring_index("memory_id", ":", 1))
    log = table(spark, folder, "events").where("event_type = 'error' AND value > 60").select(F.concat(F.lit("U"), "user_id").alias("keyword"))
    return lifecycle.verify_lessons(rows, log).select("memory_id", F.round("salience", 6).alias("salience"), "lane")


@query(
    """SELECT 'documents' AS name, count(*) AS rows, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty, max(doc_id) AS newest FROM documents UNION ALL
 SELECT 'turns', count(*), count(*) FILTER (WHERE text IS NULL OR trim(text) = ''), max(conv_id * 1000 + turn) FROM conversations UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE props IS NULL OR trim(props) = ''), max(event_id) FROM events"""
)
def h18_health(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the tables, those without content, and the newest of each: one scan a table."""
    looked = (("documents", "documents", "text", F.col("doc_id")), ("turns", "conversations", "text", F.col("conv_id") * 1000 + F.col("turn")), ("events", "events", "props", F.col("event_id")))
    rows = [table(spark, folder, t).agg(F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "").alias("empty"), F.max(key).alias("newest")).select(F.lit(n).alias("name"), "*") for n, t, c, key in looked]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY recorded_s DESC, id DESC) AS rn FROM facts) x WHERE rn <= 50)
 SELECT a.category, a.id, count(*) AS conflicts FROM r a JOIN r b ON a.category = b.category AND a.id <> b.id AND ((contains(a.fact_value, 'heat') AND contains(b.fact_value, 'shed')) OR (contains(a.fact_value, 'shed') AND contains(b.fact_value, 'heat'))
 OR (contains(a.fact_value, 'license') AND contains(b.fact_value, 'token')) OR (contains(a.fact_value, 'token') AND contains(b.fact_value, 'license'))) GROUP BY a.category, a.id""",
    "facts",
)
def i3_trigger_words(spark: SparkSession, folder: str) -> DataFrame:
    """Contradictions by trigger words, among each category's latest facts: with how many each fact is in one."""
    latest = pairs.latest_of(relation(spark, folder, "facts"), "category", [F.desc("recorded_s"), F.desc("id")], 50)
    found = pairs.conflict_counts(*pairs.conflicts(latest, [("heat", "shed"), ("license", "token")], "category", "fact_value"))
    return found.join(latest.select("id", "category"), "id").select("category", "id", "conflicts")


@query(
    """WITH c AS (SELECT p_partkey AS crystal_id, CASE p_size % 3 WHEN 0 THEN 'candidate' ELSE 'approved' END AS status, CAST(p_size % 2 AS BIGINT) AS uses, CAST(0 AS BIGINT) AS successes FROM part),
 u AS (SELECT l_partkey AS crystal_id, count(*) AS n, count(*) FILTER (WHERE l_quantity > 30) AS k FROM lineitem GROUP BY 1), s AS (SELECT crystal_id, status, uses + coalesce(n, 0) AS uses, successes + coalesce(k, 0) AS successes FROM c LEFT JOIN u USING (crystal_id))
 SELECT crystal_id, uses, successes, CASE WHEN status = 'approved' AND uses >= 3 AND successes / greatest(uses, 1) < 0.34E0 THEN 'archived' ELSE status END AS status FROM s"""
)
def i7_prune_crystals(spark: SparkSession, folder: str) -> DataFrame:
    """Crystals after their uses; approved ones that fail too often are archived."""
    status = F.when(F.col("p_size") % 3 == 0, "candidate").otherwise("approved")
    crystals = table(spark, folder, "part").select(F.col("p_partkey").alias("crystal_id"), status.alias("status"), (F.col("p_size") % 2).cast("long").alias("uses"), F.lit(0).cast("long").alias("successes"))
    uses = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("crystal_id"), (F.col("l_quantity") > 30).alias("success"))
    return pairs.use_crystals(crystals, uses)


@query(
    f"""WITH h AS (SELECT *, split_part(memory_id, ':', 1) AS u, salience * exp(-ln(2) / 30E0 * ({SQL_LANES}) * greatest({HEAT_AS_OF} - last_s, 0) / 86400E0) AS d, greatest({HEAT_AS_OF} - last_s, 0) AS idle FROM {HEAT}),
 k AS (SELECT a.memory_id, count(*) AS k FROM h a JOIN h b ON a.u = b.u AND a.memory_id <> b.memory_id AND ((contains(a.memory_id, 'click') AND contains(b.memory_id, 'error')) OR (contains(a.memory_id, 'error') AND contains(b.memory_id, 'click'))) GROUP BY 1),
 l AS (SELECT memory_id, d * pow(0.5E0, coalesce(k, 0)) AS s, lane FROM h LEFT JOIN k USING (memory_id) WHERE NOT (d < 0.2E0 AND idle > 30 * 86400))
 SELECT memory_id, round(CASE WHEN lane <> 'lesson' THEN s WHEN logged THEN 1E0 ELSE least(1E0, s + 0.05E0) END, 6) AS salience, CASE WHEN lane <> 'lesson' OR logged THEN lane ELSE 'knowledge' END AS lane FROM
 (SELECT *, split_part(memory_id, ':', 1) IN (SELECT concat('u', CAST(user_id AS VARCHAR)) FROM events WHERE event_type = 'error' AND value > 60) AS logged FROM l) t""",
    "salience",
)
def i10_consolidation(spark: SparkSession, folder: str) -> DataFrame:
    """Decay, the penalty of conflicts, eviction, and lessons looked up in the error log, as one plan; metrics, crystals and the audit are queries of their own on its result."""
    rows = lifecycle.decay_all(heat(spark, folder), HEAT_AS_OF).withColumn("user_id", F.substring_index("memory_id", ":", 1))
    found = pairs.conflict_counts(*pairs.conflicts(rows, [("click", "error")], "user_id", "memory_id", "memory_id"))
    punished = pairs.penalise(rows.where("NOT evicted").select(F.col("memory_id").alias("id"), "lane", F.col("decayed").alias("salience")), found)
    left = punished.select(F.col("id").alias("memory_id"), F.col("penalised").alias("salience"), "lane", F.substring_index("id", ":", 1).alias("keyword"))
    log = table(spark, folder, "events").where("event_type = 'error' AND value > 60").select(F.concat(F.lit("u"), "user_id").alias("keyword"))
    done = left.where("lane <> 'lesson'").select("memory_id", "salience", "lane").unionByName(lifecycle.verify_lessons(left, log))
    return done.select("memory_id", F.round("salience", 6).alias("salience"), "lane")


@query(
    f"""SELECT key, idle, win, parts, chars, count(*) AS facts FROM (SELECT concat(coalesce(agent_id, CASE WHEN id % 3 = 0 THEN 'default' ELSE '' END), CASE WHEN id % 3 = 0 THEN '' ELSE concat('::s', CAST(id % 10 AS VARCHAR)) END, CASE WHEN p = 'default' THEN '' ELSE concat('::', p) END) AS key,
 CASE p WHEN 'tech' THEN 8E0 WHEN 'intimate' THEN 20E0 ELSE 12E0 END AS idle, CASE p WHEN 'tech' THEN 2.5E0 WHEN 'intimate' THEN 8E0 ELSE 4E0 END AS win, CASE p WHEN 'tech' THEN 6 WHEN 'intimate' THEN 12 ELSE 8 END AS parts, CASE p WHEN 'tech' THEN 1500 WHEN 'intimate' THEN 3000 ELSE 2000 END AS chars
 FROM (SELECT *, {SQL_PROFILE} AS p FROM facts) a) b GROUP BY ALL""",
    "facts",
)
def j1_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The buffers that facts would go to, with the limits of their profiles; a third of them have no session."""
    profile = profile_of_fact()
    session = F.when(F.col("id") % 3 != 0, F.concat(F.lit("s"), (F.col("id") % 10).cast("string")))
    rows = relation(spark, folder, "facts").select(rules.coalesce_key(F.col("agent_id"), session, profile).alias("key"), profile.alias("p"))
    limits = {n: scores.choose(F.col("p"), {k: v[j] for k, v in PROFILES.items()}, PROFILES["default"][j]) for j, n in enumerate(("idle", "win", "parts", "chars"))}
    return rows.select("key", *[c.alias(n) for n, c in limits.items()]).groupBy("key", "idle", "win", "parts", "chars").agg(F.count("*").alias("facts"))


@query("SELECT id, CASE WHEN length(fact_value) > 60 THEN concat(substring(fact_value, 1, 60), '...') ELSE fact_value END AS summary FROM facts WHERE archived = 0", "facts")
def k2_summary(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").where("archived = 0").select("id", text.summary(F.col("fact_value")).alias("summary"))


@query(
    """WITH g AS (SELECT user_id AS agent_id, max(ts_s) AS last_seen_s, CASE WHEN user_id IN ('u3', 'u5') THEN 0 ELSE 1 END AS active, CASE user_id WHEN 'u1' THEN 'tech' WHEN 'u2' THEN '' END AS profile FROM turns GROUP BY user_id), m AS (SELECT max(last_seen_s) AS m FROM g)
 SELECT agent_id, coalesce(nullif(profile, ''), 'default') AS profile, active = 1 AND last_seen_s >= m - 86400 AND agent_id <> 'u1' AS peer FROM g, m UNION ALL SELECT 'nobody', 'default', false""",
    "turns",
)
def k4_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Agents' profiles, and who takes part beside u1: those that are active and were seen within a day of the last one."""
    turns = relation(spark, folder, "turns")
    user = F.col("user_id")
    agents = turns.groupBy(user.alias("agent_id")).agg(F.max("ts_s").alias("last_seen_s"))
    name = F.col("agent_id")
    agents = agents.select("agent_id", "last_seen_s", F.when(name.isin("u3", "u5"), 0).otherwise(1).alias("active"), F.when(name == "u1", "tech").when(name == "u2", "").alias("profile"))
    now = turns.agg(F.max("ts_s")).first()[0] or 0
    peers = lifecycle.active_peers(agents, now, DAY, "u1").select("agent_id", F.lit(True).alias("peer"))
    refs = agents.select("agent_id").unionByName(spark.sql("SELECT 'nobody' AS agent_id"))
    return lifecycle.profiles_of(refs, agents).join(peers, "agent_id", "left").select("agent_id", "profile", F.coalesce("peer", F.lit(False)).alias("peer"))


@query("SELECT id, fact_key FROM facts WHERE archived = 0 AND category = 'src7' ORDER BY recorded_s DESC, id DESC LIMIT 100", "facts")
def k5_latest_of_category(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").where("archived = 0 AND category = 'src7'").orderBy(F.desc("recorded_s"), F.desc("id")).limit(100).select("id", "fact_key")


@query(
    "SELECT session_id, count(*) AS blocks, min(CASE WHEN turn = 0 THEN sha256(content) END) AS first_hash, min(ts_s) AS created_s FROM turns WHERE turn < 5 AND content IS NOT NULL GROUP BY session_id", "turns"
)
def k16_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions' checkpoints, read as maps."""
    rows = relation(spark, folder, "turns").where("turn < 5 AND content IS NOT NULL")
    found = writes.checkpoint_of(rows.select("session_id", F.concat(F.lit("k"), F.col("turn").cast("string")).alias("block_key"), "content", F.col("ts_s").alias("created_s")))
    return found.select("session_id", F.size("blocks").cast("long").alias("blocks"), F.sha2(F.try_element_at("blocks", F.lit("k0")), 256).alias("first_hash"), "created_s")


@query("SELECT r_name AS path, 'root' AS kind FROM region UNION ALL SELECT DISTINCT n_name, 'seed' FROM nation WHERE n_name NOT IN (SELECT r_name FROM region) UNION ALL SELECT 'UNFILED', 'seed'")
def k17_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Default rows that aren't there yet: nations, one region that is there, and a place for the rest."""
    have = table(spark, folder, "region").select(F.col("r_name").alias("path"), F.lit("root").alias("kind"))
    seeds = table(spark, folder, "nation").select(F.col("n_name").alias("path"), F.lit("seed").alias("kind")).distinct()
    return writes.add_seeds(have, seeds.unionByName(spark.sql("SELECT * FROM VALUES ('ASIA', 'seed'), ('UNFILED', 'seed') t(path, kind)")), "path")


