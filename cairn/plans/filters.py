"""Scans, projections, filters and rules over facts, turns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources.tables import AS_OF, DAY, relation, table
from ..streaming import ingest
from .registry import query

TIER_WORDS = {"procedural": ("token", "license"), "episodic": ("from", "was"), "semantic": ("the",)}
LANE_WORDS = {"identity": ("his ", "her "), "rule": ("must", "that"), "evidence": ("this", "with", "from"), "knowledge": ("license", "version")}


@query("SELECT id, category, fact_key, summary FROM (SELECT id, category, fact_key, substring(fact_value, 1, 60) AS summary FROM facts WHERE category = 'src3') t", "facts")
def a1_scan_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").where(F.col("category") == "src3")
    return facts.select("id", "category", "fact_key", F.substring("fact_value", 1, 60).alias("summary"))


@query(
    "SELECT id, CASE WHEN length(fact_value) > 60 THEN concat(substring(fact_value, 1, 60), '...') ELSE fact_value END AS summary, length(fact_value) AS chars, CAST(ceil(length(fact_value) / 4E0) AS BIGINT) AS tokens FROM facts",
    "facts",
)
def a2_levels(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("fact_value")
    return relation(spark, folder, "facts").select("id", text.summary(value).alias("summary"), F.length(value).cast("long").alias("chars"), F.ceil(F.length(value) / 4).alias("tokens"))


@query(
    """WITH n AS (SELECT session_id * 1000 + turn AS id, * FROM turns WHERE role IN ('user', 'assistant') AND length(content) > 10 AND session_id * 1000 + turn > 50000 ORDER BY id LIMIT 200),
 s AS (SELECT conv_id AS session_id, count(*) AS turns FROM conversations WHERE conv_id % 4 <> 2 GROUP BY conv_id)
 SELECT n.id, user_id, n.session_id, role, md5(substring(content, 1, 2000)) AS content_hash, coalesce(s.turns, -1) AS session_turns, (SELECT max(id) FROM n) AS cursor FROM n LEFT JOIN s ON s.session_id = n.session_id""",
    "turns",
)
def a6_new_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The first messages after a cursor, cut, with their sessions, of which a quarter is missing, and the new cursor."""
    turns = relation(spark, folder, "turns").withColumn("id", F.col("session_id") * 1000 + F.col("turn"))
    sessions = table(spark, folder, "conversations").where("conv_id % 4 <> 2").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n"))
    new = ingest.readable(turns.where("id > 50000")).orderBy("id").limit(200)
    rows = new.withColumn("cursor", F.max("id").over(Window.partitionBy(F.lit(1)))).join(sessions, "session_id", "left")  # of the limit's rows
    return rows.select("id", "user_id", "session_id", "role", F.md5("content").alias("content_hash"), F.coalesce("n", F.lit(-1)).alias("session_turns"), "cursor")


@query(
    """SELECT session_id, turns, sha256(talk) AS talk_hash, length(talk) AS chars FROM (SELECT session_id, count(*) AS turns, string_agg(concat(role, ': ', content), chr(10) ORDER BY turn) AS talk FROM turns GROUP BY session_id) t
 WHERE turns >= 2""",
    "turns",
)
def a7_conversations(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    talks = relation(spark, folder, "turns").groupBy("session_id").agg(F.count("*").alias("turns"), F.array_join(lines, "\n").alias("talk")).where("turns >= 2")
    return talks.select("session_id", "turns", F.sha2("talk", 256).alias("talk_hash"), F.length("talk").cast("long").alias("chars"))


@query(
    """SELECT page_id, CAST(len(links) AS BIGINT) AS n_links, links[1] AS first_link FROM (SELECT page_id, list_distinct(l) AS d, l AS links0,
 list_filter(l, lambda x, i: list_position(l, x) = i) AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]*)', 1) AS l FROM pages) a) t"""
)
def a9_links(spark: SparkSession, folder: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]*)'), F.lit(1)))
    return table(spark, folder, "pages").select("page_id", links.alias("links")).select("page_id", F.size("links").cast("long").alias("n_links"), F.get("links", F.lit(0)).alias("first_link"))


@query("SELECT id FROM facts WHERE coalesce(agent_id = 'agent_a' OR category = 'agent_a' OR agent_id = 'local', false)", "facts")
def b1_tenant(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").where(rules.tenant("agent_a", F.col("agent_id"), F.col("category"))).select("id")


@query("SELECT id, coalesce(agent_id, 'local') AS agent FROM facts WHERE coalesce(agent_id, 'local') IN ('local', 'agent_b') AND profile = 'default' AND coalesce(shared, 1) = 1", "facts")
def b3_defaults(spark: SparkSession, folder: str) -> DataFrame:
    agent = F.coalesce("agent_id", F.lit("local"))
    facts = relation(spark, folder, "facts").where(agent.isin("local", "agent_b") & (F.col("profile") == "default") & (F.coalesce("shared", F.lit(1)) == 1))
    return facts.select("id", agent.alias("agent"))


@query("SELECT id FROM facts WHERE (valid_to_s IS NULL OR valid_to_s >= 1717200000) AND (valid_from_s IS NULL OR valid_from_s <= 1725148800)", "facts")
def b5_valid_between(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").where(rules.valid_between(F.col("valid_from_s"), F.col("valid_to_s"), 1_717_200_000, 1_725_148_800)).select("id")


@query("SELECT id, strftime(to_timestamp(recorded_s) AT TIME ZONE 'UTC', '%Y-%m') AS month FROM facts WHERE recorded_s >= 1709251200 AND recorded_s < 1711929600", "facts")
def b6_time_window(spark: SparkSession, folder: str) -> DataFrame:
    facts = relation(spark, folder, "facts").where("recorded_s >= 1709251200 AND recorded_s < 1711929600")
    return facts.select("id", F.date_format(F.timestamp_seconds("recorded_s"), "yyyy-MM").alias("month"))


SQL_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: lower(trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))), lambda x: x <> '')"


@query(
    f"""WITH c AS (SELECT doc_id, text, regexp_replace(substring(text, 1, {rules.MOST_CHARS}), '{rules.CONTROLS}', '', 'g') AS t FROM documents),
 n AS (SELECT doc_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest({SQL_LINES}) AS x FROM c) l GROUP BY doc_id, x) g GROUP BY doc_id),
 b AS (SELECT *, lower(regexp_replace(t, '[^0-9a-zA-Z一-鿿]', '', 'g')) AS bare FROM c)
 SELECT b.doc_id, CAST(length(t) AS BIGINT) AS chars, CASE WHEN text = '' THEN 'empty' WHEN regexp_matches(t, '{rules.INJECTION}') THEN 'pattern' WHEN length(bare) >= 4 AND regexp_matches(bare, '{rules.INJECTION_BARE}') THEN 'hidden'
 WHEN coalesce(lines > 6 AND most >= 3 AND most / lines > 0.3E0, false) THEN 'repeated' ELSE 'ok' END AS verdict FROM b LEFT JOIN n USING (doc_id)"""
)
def b9_guard(spark: SparkSession, folder: str) -> DataFrame:
    body = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.length(rules.cleaned(body)).cast("long").alias("chars"), rules.guard(body).alias("verdict"))


@query(
    f"""SELECT d.doc_id, coalesce(lines > 6 AND most >= 3 AND most / lines > 0.3E0, false) AS repeats FROM documents d LEFT JOIN (SELECT doc_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS lines FROM
 (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest({SQL_LINES.replace('string_split(t,', 'string_split(text,')}) AS x FROM documents) l GROUP BY doc_id, x) g GROUP BY doc_id) n USING (doc_id)"""
)
def b9_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce(rules.repeats_lines(F.col("text")), F.lit(False)).alias("repeats"))


def sql_any(text: str, patterns: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns)


def sql_noise(text: str) -> str:
    """SQL for rules.is_noise: a core is a token's letters and digits."""
    rows = " OR ".join(f"contains('{k}', core) OR contains('{k[::-1]}', core)" for k in rules.KEY_ROWS)
    digits = "regexp_full_match(core, '[0-9]+') AND (contains('0123456789', core) OR contains('9876543210', core))"
    junk = f"core = '' OR (length(core) >= 3 AND (replace(core, core[1], '') = '' OR {rows} OR ({digits})))"
    cores = f"list_transform(list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> ''), lambda t: lower(regexp_replace(t, '[^0-9A-Za-z]', '', 'g')))"
    mash = f"NOT regexp_matches({text}, '{rules.CJK}') AND len(list_filter({cores}, lambda core: NOT ({junk}))) = 0"
    return f"(length({text}) < 2 OR replace({text}, {text}[1], '') = '' OR NOT regexp_matches({text}, '[\\p{{L}}\\p{{N}}_]') OR ({mash}))"


def sql_screen(text: str) -> str:
    """SQL for rules.screen."""
    return f"CASE WHEN {sql_any(text, rules.SECRETS)} THEN 'reject:secret' WHEN {sql_noise(f'trim({text})')} THEN 'reject:noise' WHEN {sql_any(text, rules.SENSITIVE)} THEN 'human_review' ELSE 'evaluate' END"


@query(f"SELECT doc_id, {sql_screen('text')} AS verdict FROM documents")
def b10_screen(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", rules.screen(F.col("text")).alias("verdict"))


@query(f"SELECT doc_id, no, {sql_noise('line')} AS noise FROM (SELECT doc_id, unnest(range(CAST(len(l) AS BIGINT))) AS no, unnest(l) AS line FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents) a) t")
def b11_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Noise among the lines of documents."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.select("doc_id", F.col("no").cast("long").alias("no"), rules.is_noise(F.col("line")).alias("noise"))


@query(
    """SELECT id, CASE WHEN contains(v, 'token') OR contains(v, 'license') THEN 'procedural' WHEN contains(v, 'from') OR contains(v, 'was') THEN 'episodic' WHEN contains(v, 'the') THEN 'semantic' ELSE 'semantic' END AS tier
 FROM (SELECT id, lower(concat(category, ' ', fact_key, ' ', fact_value)) AS v FROM facts) t""",
    "facts",
)
def b12_tier(spark: SparkSession, folder: str) -> DataFrame:
    value = F.concat_ws(" ", "category", "fact_key", "fact_value")
    return relation(spark, folder, "facts").select("id", rules.first_tier(value, TIER_WORDS).alias("tier"))


@query(
    """SELECT id, CASE WHEN greatest(a, b, c, d) = 0 THEN 'general' WHEN a >= greatest(b, c, d) THEN 'identity' WHEN b >= greatest(c, d) THEN 'rule' WHEN c >= d THEN 'evidence' ELSE 'knowledge' END AS lane FROM
 (SELECT id, contains(fact_value, 'his ')::INT + contains(fact_value, 'her ')::INT AS a, contains(fact_value, 'must')::INT + contains(fact_value, 'that')::INT AS b,
 contains(fact_value, 'this')::INT + contains(fact_value, 'with')::INT + contains(fact_value, 'from')::INT AS c, contains(fact_value, 'license')::INT + contains(fact_value, 'version')::INT AS d FROM facts) t""",
    "facts",
)
def b16_lane(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "facts").select("id", rules.lane_of(F.col("fact_value"), LANE_WORDS).alias("lane"))


@query(
    f"""SELECT user_id, last_s, last_s < {AS_OF} - 3 * 86400 AS stale FROM (SELECT user_id, max(ts_s) AS last_s FROM turns GROUP BY user_id) t""",
    "turns",
)
def b22_stale(spark: SparkSession, folder: str) -> DataFrame:
    seen = relation(spark, folder, "turns").groupBy("user_id").agg(F.max("ts_s").alias("last_s"))
    return seen.withColumn("stale", F.col("last_s") < AS_OF - 3 * DAY)
