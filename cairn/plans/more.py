"""Smaller operators: payloads, validity, aliases, review queues, ledgers, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from ..operators import graph, lifecycle, pairs, recall, writes
from ..sources.tables import AS_OF, DAY, relation, table
from .filters import sql_screen
from .lifecycle import HEAT, HEAT_AS_OF, heat
from .registry import query
from .textual import SQL_JACCARD, sql_grams

#: A small vocabulary for the queries; the operators take any.
KIND_WORDS = {"DECISIONS": "license|version", "PREFERENCES": "her|his", "EXPERIENCES": "ing ", "OBSERVATIONS": "tion", "REFLECTIONS": "zz"}


@query(
    "SELECT session_id, turn, role, content FROM turns WHERE trim(content) <> '' AND role <> 'system'",
    "turns",
)
def a4_iter_turns(spark: SparkSession, folder: str) -> DataFrame:
    """A session's payload, an array of messages, in rows again; empty messages and system ones go."""
    turns = relation(spark, folder, "turns")
    payload = turns.groupBy("session_id").agg(F.collect_list(F.struct("turn", "role", "content")).alias("messages"))  # a session's few turns
    rows = payload.select("session_id", F.explode("messages").alias("m")).select("session_id", "m.turn", "m.role", "m.content")
    return rows.where((F.trim("content") != "") & (F.col("role") != "system"))


@query(
    f"SELECT id, strftime(to_timestamp(CASE WHEN n IS NULL THEN {AS_OF} WHEN n > 1000000000000 THEN n / 1000 ELSE n END) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS iso FROM (SELECT id, CASE id % 3 WHEN 0 THEN recorded_s WHEN 1 THEN recorded_s * 1000 END AS n FROM facts) t",
    "facts",
)
def a5_normalise_time(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds or milliseconds, told apart by size, as ISO text; a missing time is as_of."""
    n = F.expr("CASE id % 3 WHEN 0 THEN recorded_s WHEN 1 THEN recorded_s * 1000 END")
    time = F.when(n > 10**12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(F.coalesce(n, F.lit(AS_OF))))
    return relation(spark, folder, "facts").select("id", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT id, concat(fact_key, ': ', fact_value, ' (', substring(fact_value, 1, 60), ')') AS message FROM facts WHERE archived = 0", "facts")
def a13_restore_messages(spark: SparkSession, folder: str) -> DataFrame:
    message = F.concat("fact_key", F.lit(": "), "fact_value", F.lit(" ("), F.substring("fact_value", 1, 60), F.lit(")"))
    return relation(spark, folder, "facts").where("archived = 0").select("id", message.alias("message"))


@query(
    """SELECT id, raw, CASE WHEN regexp_full_match(raw, '[0-9]{4}') THEN concat(raw, '-01-01') WHEN regexp_full_match(raw, '[0-9]{4}-[0-9]{2}') THEN coalesce(CAST(TRY_CAST(concat(raw, '-01') AS DATE) AS VARCHAR), raw) ELSE raw END AS after,
 CASE WHEN regexp_full_match(raw, '[0-9]{4}') THEN concat(raw, '-12-31') WHEN regexp_full_match(raw, '[0-9]{4}-[0-9]{2}') THEN coalesce(CAST(last_day(TRY_CAST(concat(raw, '-01') AS DATE)) AS VARCHAR), raw) ELSE raw END AS before FROM
 (SELECT id, CASE id % 4 WHEN 0 THEN '2024' WHEN 1 THEN concat('2024-', lpad(CAST(id % 14 AS VARCHAR), 2, '0')) WHEN 2 THEN '2024-02-29' ELSE '2024-05-06T07:08:09' END AS raw FROM facts) t""",
    "facts",
)
def b4_time_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The first and the last day that a bound means: a year, a month (an impossible one stays), a day or more."""
    month = F.concat(F.lit("2024-"), F.lpad((F.col("id") % 14).cast("string"), 2, "0"))
    raw = F.when(F.col("id") % 4 == 0, "2024").when(F.col("id") % 4 == 1, month).when(F.col("id") % 4 == 2, "2024-02-29").otherwise("2024-05-06T07:08:09")
    return relation(spark, folder, "facts").select("id", raw.alias("raw")).select("id", "raw", text.bound_day(F.col("raw"), False).alias("after"), text.bound_day(F.col("raw"), True).alias("before"))


SQL_GATE = " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{reason}'" for reason, _, p in rules.GATE)


@query(
    f"""SELECT session_id, turn, reason, CASE WHEN reason IN ('correction_detected', 'explicit_recall', 'reference') THEN 'episode' WHEN reason = 'self_reference' THEN 'identity' WHEN reason = 'content_query' THEN 'pinned' ELSE '' END AS scope FROM
 (SELECT session_id, turn, CASE WHEN length(q) < 3 THEN 'query_too_short' {SQL_GATE} WHEN length(q) > 15 AND (len(regexp_extract_all(q, '{rules.CJK}')) >= 5 OR regexp_matches(q, '{rules.CONTENT_WORDS}')) THEN 'content_query' ELSE 'no_signal' END AS reason
 FROM (SELECT session_id, turn, trim(content, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS q FROM turns) a) t""",
    "turns",
)
def b8_relevance_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a query needs memory, and of what scope: the first rule that holds."""
    found = relation(spark, folder, "turns").select("session_id", "turn", rules.relevance(F.col("content")).alias("g"))
    return found.select("session_id", "turn", "g.reason", F.coalesce("g.scope", F.lit("")).alias("scope"))


@query("SELECT id, CASE WHEN category IN ('src0', 'src1') THEN 'L0' WHEN starts_with(category, 'src1') THEN 'L1' ELSE 'L2' END AS level FROM facts", "facts")
def b13_auto_level(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("category")
    return relation(spark, folder, "facts").select("id", F.when(c.isin("src0", "src1"), "L0").when(F.startswith(c, F.lit("src1")), "L1").otherwise("L2").alias("level"))


@query(
    "SELECT id, CASE id % 5 WHEN 0 THEN 'federated' WHEN 1 THEN 'hot' ELSE CASE WHEN regexp_matches(fact_value, 'version|token') AND id % 7 > 0 THEN 'federated' ELSE 'hot' END END AS route FROM facts",
    "facts",
)
def b19_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Explicit flags for some, hints in the text for others, and some without peers."""
    flag = F.when(F.col("id") % 5 == 0, True).when(F.col("id") % 5 == 1, False)
    return relation(spark, folder, "facts").select("id", rules.routed(F.col("fact_value"), flag, F.col("id") % 7, "version|token").alias("route"))


@query(
    f"""SELECT id, array_to_string(list_slice(list_filter(regexp_extract_all(t, '[a-zA-Z0-9_-]{{2,}}|[一-龥]{{2,4}}'), lambda w: NOT list_contains({list(text.NO_TAGS)}, w)), 1, 3), ',') AS tags FROM
 (SELECT id, concat(CASE id % 3 WHEN 0 THEN '我们 围棋 可以，' ELSE '' END, fact_value) AS t FROM facts) a""",
    "facts",
)
def c18_tags(spark: SparkSession, folder: str) -> DataFrame:
    value = F.concat(F.when(F.col("id") % 3 == 0, "我们 围棋 可以，").otherwise(""), "fact_value")
    return relation(spark, folder, "facts").select("id", F.array_join(text.tags(value), ",").alias("tags"))


@query("SELECT doc_id, CASE WHEN s = '' THEN substring(md5(h), 1, 12) ELSE s END AS slug FROM (SELECT doc_id, substring(text, 1, 40) AS h, trim(regexp_replace(lower(substring(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents) t")
def c16_slug(spark: SparkSession, folder: str) -> DataFrame:
    head = F.substring("text", 1, 40)
    slug = F.btrim(F.regexp_replace(F.lower(head), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, folder, "documents").select("doc_id", F.when(slug == "", F.substring(F.md5(head), 1, 12)).otherwise(slug).alias("slug"))


@query("SELECT id, concat(category, ',', memory_tier, CASE WHEN profile <> memory_tier THEN concat(',', profile) ELSE '' END) AS tags FROM facts", "facts")
def c21_merge_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The union of two comma lists, in order."""
    a, b = F.concat_ws(",", "category", "memory_tier"), F.concat_ws(",", "memory_tier", "profile")
    tags = F.array_distinct(F.concat(F.split(a, ","), F.split(b, ",")))
    return relation(spark, folder, "facts").select("id", F.array_join(tags, ",").alias("tags"))


@query("SELECT id, CASE WHEN s IS NULL THEN 0.5E0 ELSE greatest(0E0, least(1E0, s)) END AS score FROM (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id % 37 AS DOUBLE) / 20 - 0.3E0 END AS s FROM facts) t", "facts")
def c23_clamp(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("id") % 9 != 0, (F.col("id") % 37).cast("double") / 20 - 0.3)
    return relation(spark, folder, "facts").select("id", F.when(raw.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).alias("score"))


@query("SELECT l.id, r.id AS other FROM facts l JOIN facts r ON r.fact_key = concat('doc:', CAST(l.id + 1 AS VARCHAR))", "facts")
def c24_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """References written with or without their prefix meet."""
    facts = relation(spark, folder, "facts")
    wanted = facts.select("id", F.explode(F.array(F.concat(F.lit("doc:"), (F.col("id") + 1).cast("string")), (F.col("id") + 1).cast("string"))).alias("fact_key"))
    return wanted.join(facts.select("fact_key", F.col("id").alias("other")), "fact_key").select("id", "other").distinct()


@query("SELECT id FROM facts WHERE archived = 0 AND coalesce(agent_id, 'local') IN ('local', 'agent_a') AND profile = 'default' AND coalesce(shared, 1) = 1 AND contains(lower(fact_value), 'tion') ORDER BY trust_score DESC, recorded_s DESC, id LIMIT 60", "facts")
def d6_federated_search(spark: SparkSession, folder: str) -> DataFrame:
    agent = F.coalesce("agent_id", F.lit("local"))
    rows = relation(spark, folder, "facts").where((F.col("archived") == 0) & agent.isin("local", "agent_a") & (F.col("profile") == "default") & (F.coalesce("shared", F.lit(1)) == 1))
    return recall.keyword_search(rows, ["tion"], "fact_value", 60, [F.desc("trust_score"), F.desc("recorded_s"), "id"]).select("id")


@query("SELECT f.id, round(0.6E0 * trust_score + 0.4E0 * coalesce(r, trust_score), 9) AS blended FROM facts f LEFT JOIN (SELECT id, CAST(id % 11 AS DOUBLE) / 10 AS r FROM facts WHERE id % 2 = 0) x USING (id)", "facts")
def d11_rerank_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Scores that any reranker gave, blended with the old ones; rows without keep theirs."""
    facts = relation(spark, folder, "facts")
    given = facts.where("id % 2 = 0").select("id", ((F.col("id") % 11).cast("double") / 10).alias("r"))
    blended = 0.6 * F.col("trust_score") + 0.4 * F.coalesce("r", "trust_score")
    return facts.join(given, "id", "left").select("id", F.round(blended, 9).alias("blended"))


NAMED = ["Assistant|Lyon|License", "[A-Z][a-z]+ly"]
SQL_NAMES = "list_concat(regexp_extract_all(fact_value, '[\"\\\\'']([^\"\\\\'']+)[\"\\\\'']', 1), " + ", ".join(f"regexp_extract_all(fact_value, '{p}')" for p in NAMED) + ")"


@query(
    f"""WITH m AS (SELECT id, list_filter(list_transform({SQL_NAMES}, lambda x: trim(x)), lambda x: x <> '') AS names FROM facts WHERE archived = 0),
 n AS (SELECT id, unnest(names) AS name, unnest(range(CAST(len(names) AS BIGINT))) AS pos FROM m), w AS (SELECT lower(name) AS low, arg_min(name, (id, pos)) AS name FROM n GROUP BY 1)
 SELECT w.name, CAST(count(DISTINCT n.id) AS BIGINT) AS facts, w.low IN (SELECT lower(p_brand) FROM part UNION ALL SELECT 'lyon') AS known FROM w JOIN n ON lower(n.name) = w.low GROUP BY w.name, w.low""",
    "facts",
)
def e6_link_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Names found in facts, each one entity whatever its case, with its facts, and whether it was known."""
    facts = relation(spark, folder, "facts").where("archived = 0")
    known = table(spark, folder, "part").select(F.col("p_brand").alias("name")).unionByName(spark.sql("SELECT 'lyon' AS name"))
    new, edges = graph.link_entities(facts, known, lambda v: text.mentions(v, NAMED))
    counts = edges.groupBy("name").agg(F.count("*").alias("facts"))
    return counts.join(new.withColumn("new", F.lit(True)), "name", "left").select("name", "facts", F.col("new").isNull().alias("known"))


@query("SELECT f.id, t.quality FROM facts f JOIN labels t ON t.doc_id = TRY_CAST(substring(f.fact_key, 5) AS BIGINT) WHERE starts_with(f.fact_key, 'doc:')", "facts")
def e8_kinds_of_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").where(F.startswith("fact_key", F.lit("doc:"))).withColumn("doc_id", F.expr("try_cast(substring(fact_key, 5) AS BIGINT)"))
    return facts.join(table(spark, folder, "labels"), "doc_id").select("id", "quality")


@query(
    f"""WITH f AS (SELECT id, coalesce(agent_id, 'local') AS agent_id, category, memory_tier, fact_value, {sql_grams('fact_value', 2)} AS g FROM facts WHERE archived = 0),
 p AS (SELECT n.id, o.id AS m, {SQL_JACCARD.format('n.g', 'o.g')} AS s FROM f n JOIN f o ON n.agent_id = o.agent_id AND n.category = o.category AND n.id <> o.id WHERE n.id % 40 < 20 AND o.id % 40 >= 20),
 best AS (SELECT id, arg_max(m, (s, -m)) AS m FROM p WHERE s >= 0.5E0 GROUP BY id),
 v AS (SELECT n.id, o.id AS fact_id, CASE WHEN length(o.fact_value) >= length(n.fact_value) THEN o.fact_value ELSE n.fact_value END AS v,
 concat(o.category, ',', o.memory_tier, CASE WHEN n.memory_tier <> o.memory_tier THEN concat(',', n.memory_tier) ELSE '' END) AS tags FROM best JOIN f n ON n.id = best.id JOIN f o ON o.id = best.m)
 SELECT id, fact_id, sha256(v) AS value_hash, substring(v, 1, 60) AS summary, tags FROM v""",
    "facts",
)
def f2_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Each new fact (every other one of its category) with the stored one that it duplicates: the longer value, on a tie the stored one, and both's tags."""
    facts = relation(spark, folder, "facts").where("archived = 0").withColumns({"agent_id": F.coalesce("agent_id", F.lit("local")), "tags": F.concat_ws(",", "category", "memory_tier")})
    new, old = facts.where("id % 40 < 20"), facts.where("id % 40 >= 20")
    found = writes.check_duplicate(new, old, merge=0.5, update=0.5).where("action = 'merge'").select("id", "match_id")
    pair = found.join(new.select("id", F.col("fact_value").alias("new_value"), F.col("tags").alias("new_tags")), "id")
    pair = pair.join(old.select(F.col("id").alias("match_id"), F.col("fact_value").alias("old_value"), F.col("tags").alias("old_tags")), "match_id")
    merged = writes.merge_values(pair).join(found, "id")
    return merged.select("id", F.col("match_id").alias("fact_id"), F.sha2("fact_value", 256).alias("value_hash"), "summary", "tags")


SQL_KEYED = "concat(fact_key, ' ', fact_value)"


@query(
    f"""SELECT id, CASE WHEN v IN ('reject:secret', 'reject:noise') THEN 'rule_rejected' WHEN v = 'human_review' THEN v ELSE 'llm_eval' END AS route, CASE WHEN starts_with(v, 'reject') THEN 'rejected' ELSE 'pending' END AS status,
 CASE WHEN starts_with(v, 'reject') THEN 1 ELSE 0 END AS archived, CASE WHEN starts_with(v, 'reject') THEN -1E0 ELSE 0.3E0 END AS trust FROM (SELECT id, {sql_screen('t')} AS v FROM (SELECT id, {SQL_KEYED} AS t FROM facts) a) b""",
    "facts",
)
def f8_govern(spark: SparkSession, folder: str) -> DataFrame:
    """New facts as candidates with provisional trust; rejected ones are archived."""
    return writes.govern(relation(spark, folder, "facts")).withColumn("trust", F.coalesce("trust", F.lit(-1.0)))


@query("SELECT id, json_extract_string(v, '$.verdict') AS verdict, TRY_CAST(json_extract_string(v, '$.confidence') AS DOUBLE) AS confidence FROM (SELECT id, concat('{\"verdict\": \"', CASE WHEN id % 2 = 0 THEN 'approve' ELSE 'reject' END, '\", \"confidence\": ', CAST(id % 10 AS VARCHAR), '}') AS v FROM facts) t", "facts")
def f13_parse_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """An evaluator's answer: JSON within a fence or a sentence; what can't be read gives nulls."""
    inner = F.concat(F.lit('{"verdict": "'), F.when(F.col("id") % 2 == 0, "approve").otherwise("reject"), F.lit('", "confidence": '), (F.col("id") % 10).cast("string"), F.lit("}"))
    answer = F.concat(F.lit("Here it is:\n```json\n"), inner, F.lit("\n``` done"))
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "verdict string, confidence double")
    return relation(spark, folder, "facts").select("id", parsed.alias("p")).select("id", "p.verdict", "p.confidence")


@query(f"SELECT memory_id, round(least(1E0, salience * exp(-ln(2) / 30E0 * (({HEAT_AS_OF} - last_s) / 86400E0)) + 0.1E0), 6) AS boosted, access_count + 1 AS access_count FROM {HEAT}", "salience")
def g2_access(spark: SparkSession, folder: str) -> DataFrame:
    """An access: decay since the last one, then a boost."""
    rate = F.exp(-F.lit(0.6931471805599453) / scores.HALF_LIFE_DAYS * (HEAT_AS_OF - F.col("last_s")) / scores.DAY)
    boosted = F.least(F.lit(1.0), F.col("salience") * rate + 0.1)
    return heat(spark, folder).select("memory_id", F.round(boosted, 6).alias("boosted"), (F.col("access_count") + 1).alias("access_count"))


@query("SELECT category, CAST(sum(CASE WHEN p > 0 THEN 1 ELSE 0 END) AS BIGINT) AS likes, CAST(sum(CASE WHEN p < 0 THEN 1 ELSE 0 END) AS BIGINT) AS dislikes FROM (SELECT category, CAST(id % 7 - 3 AS DOUBLE) / 3 AS p FROM facts) t WHERE abs(p) >= 0.5E0 GROUP BY category", "facts")
def g9_preferences(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").select("category", ((F.col("id") % 7 - 3).cast("double") / 3).alias("p"))
    return facts.where(F.abs("p") >= 0.5).groupBy("category").agg(F.count_if(F.col("p") > 0).alias("likes"), F.count_if(F.col("p") < 0).alias("dislikes"))


SQL_REFINE = """SELECT category, list_sort(list(id)) AS ids, concat(category, ': ', array_to_string(list_slice(list_sort(list_distinct(list(fact_key))), 1, 8), ', ')) AS summary FROM
 (SELECT *, row_number() OVER (PARTITION BY category ORDER BY recorded_s DESC, id DESC) AS rn FROM facts WHERE archived = 0) t WHERE rn <= 20 GROUP BY category HAVING count(*) >= 3"""


@query(f"SELECT category, array_to_string(ids, ',') AS sources, summary FROM ({SQL_REFINE}) r", "facts")
def g13_refine(spark: SparkSession, folder: str) -> DataFrame:
    """A proposal to merge a category's latest facts, with its sources."""
    found = pairs.refine(relation(spark, folder, "facts"))
    return found.select("category", F.array_join(F.transform("source_ids", lambda i: i.cast("string")), ",").alias("sources"), "summary")


@query(
    f"""SELECT id, category, fact_key, CASE WHEN id IN (SELECT unnest(ids) FROM ({SQL_REFINE}) r) THEN 1 ELSE archived END AS archived, 'source' AS kind FROM facts
 UNION ALL SELECT -ids[1] - 1, category, concat('refined:', CAST(ids[1] AS VARCHAR)), 0, summary FROM ({SQL_REFINE}) r""",
    "facts",
)
def g13_apply_refinements(spark: SparkSession, folder: str) -> DataFrame:
    """Facts after all proposals: sources archived, and a refined fact for each category."""
    facts = relation(spark, folder, "facts")
    after = pairs.apply_refinements(facts, pairs.refine(facts))
    return after.select("id", "category", "fact_key", "archived", F.when(F.col("id") < 0, F.col("fact_value")).otherwise("source").alias("kind"))


@query("SELECT id, fact_key, archived FROM facts", "facts")
def g13_undo_refinements(spark: SparkSession, folder: str) -> DataFrame:
    """Applied and undone, facts are as they were."""
    facts = relation(spark, folder, "facts")
    proposals = pairs.refine(facts)
    return pairs.undo_refinements(pairs.apply_refinements(facts, proposals), proposals).select("id", "fact_key", "archived")


@query("SELECT user_id, count(*) AS gone FROM turns WHERE user_id IN ('u1', 'u2') GROUP BY user_id", "turns")
def g17_purge_counts(spark: SparkSession, folder: str) -> DataFrame:
    turns = relation(spark, folder, "turns").withColumn("ref", F.col("user_id"))
    left = lifecycle.cascade_delete({"turns": turns}, turns.where(F.col("user_id").isin("u1", "u2")).select("ref"))["turns"]
    counts = lambda df, n: df.groupBy("user_id").agg(F.count("*").alias(n))
    both = counts(turns, "before").join(counts(left, "after"), "user_id", "left")
    return both.select("user_id", (F.col("before") - F.coalesce("after", F.lit(0))).alias("gone")).where("gone > 0")


@query("SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS kind, count(*) AS refs, round(avg(quality), 3) AS mean FROM labels GROUP BY 1")
def h6_kind_stats(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("kind")
    return table(spark, folder, "labels").groupBy(kind).agg(F.count("*").alias("refs"), F.round(F.avg("quality"), 3).alias("mean"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS value FROM events GROUP BY 1")
def h15_usage(spark: SparkSession, folder: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, folder, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(kind("click").alias("clicks"), kind("error").alias("errors"), F.round(F.sum("value"), 4).alias("value"))


@query("SELECT category, list_aggregate(list_slice(list(fact_key ORDER BY trust_score DESC, id), 1, 5), 'string_agg', ',') AS keys FROM facts WHERE archived = 0 GROUP BY category", "facts")
def h20_persona(spark: SparkSession, folder: str) -> DataFrame:
    """The best keys of each category: ranked first, so that only five are gathered."""
    best = pairs.latest_of(relation(spark, folder, "facts").where("archived = 0"), "category", [F.desc("trust_score"), "id"], 5)
    return best.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "fact_key"))), lambda x: x["fact_key"]), ",").alias("keys"))


@query("SELECT id, recorded_s FROM facts WHERE archived = 0 ORDER BY recorded_s DESC, id DESC LIMIT 100", "facts")
def h21_recent(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").where("archived = 0").orderBy(F.desc("recorded_s"), F.desc("id")).limit(100).select("id", "recorded_s")


@query("SELECT category, count(*) AS solutions FROM facts WHERE regexp_matches(lower(fact_value), 'first|then|license|step') GROUP BY category HAVING count(*) >= 3", "facts")
def i8_skills(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").where(F.lower("fact_value").rlike("first|then|license|step"))
    return facts.groupBy("category").agg(F.count("*").alias("solutions")).where("solutions >= 3")


@query(f"SELECT id, recorded_s, CAST(floor(({AS_OF} - recorded_s) / 86400E0) AS BIGINT) AS age_days FROM facts WHERE recorded_s >= {AS_OF} - 7 * 86400", "facts")
def k19_week_report(spark: SparkSession, folder: str) -> DataFrame:
    recent = relation(spark, folder, "facts").where(F.col("recorded_s") >= AS_OF - 7 * DAY)
    return recent.select("id", "recorded_s", F.floor((AS_OF - F.col("recorded_s")) / DAY).alias("age_days"))
