"""Queries of sources, searches, deletion and bursts by their whole rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import lifecycle, recall, writes
from ..sources.tables import AS_OF, relation, table
from ..streaming import coalesce
from .filters import TIER_WORDS
from .ingest import SQL_TIERS
from .registry import query
from .streams import sql_waves

SQL_SPACES = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NOTES = "replace(replace(text, chr(10), ' § '), '. ', '.§ ')"


@query(
    f"""WITH s AS (SELECT doc_id, unnest(range(CAST(len(string_split({NOTES}, '§')) AS BIGINT))) AS no, trim(unnest(string_split({NOTES}, '§')), {SQL_SPACES}) AS section FROM documents),
 h AS (SELECT doc_id, no, substring(md5(section), 1, 12) AS section_id FROM s WHERE length(section) > 5)
 SELECT * FROM h WHERE doc_id % 4 <> 0 AND section_id NOT IN (SELECT section_id FROM h WHERE doc_id % 4 = 0)"""
)
def a8_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of notes, cut at their mark, that were not seen in an earlier sync (that of every fourth note)."""
    notes = table(spark, folder, "documents").select("doc_id", F.replace(F.replace("text", F.lit("\n"), F.lit(" § ")), F.lit(". "), F.lit(".§ ")).alias("note"))
    found = text.sections(notes, "doc_id", "note")
    seen = found.where("doc_id % 4 = 0").select("section_id").distinct()
    return found.where("doc_id % 4 <> 0").join(seen, "section_id", "left_anti").select("doc_id", "no", "section_id")


#: Pages as notes: the links of a page in double brackets, with a part of the page and another name.
SQL_WIKI = "regexp_replace(html, '<a href=\"([^\"]*)\">([^<]*)</a>', '[[{0}#part|{1}]] [[{1}]]'{2})"


@query(
    f"""WITH l AS (SELECT page_id, list_filter(list_transform(regexp_extract_all({SQL_WIKI.format(chr(92) + '1', chr(92) + '2', ", 'g'")}, '\\[\\[(.*?)\\]\\]', 1), lambda x: trim(split_part(split_part(x, '|', 1), '#', 1), {SQL_SPACES})), lambda x: x <> '') AS l FROM pages)
 SELECT page_id, CAST(no AS BIGINT) AS no, link FROM (SELECT page_id, unnest(range(len(u))) AS no, unnest(u) AS link FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM l) a) b"""
)
def a9_wikilinks(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that notes name in double brackets, without other names and parts, each once, in order."""
    notes = table(spark, folder, "pages").select("page_id", F.expr(SQL_WIKI.format("$1", "$2", "")).alias("note"))
    return notes.select("page_id", F.posexplode(text.wikilinks(F.col("note"))).alias("no", "link")).withColumn("no", F.col("no").cast("long"))


LOG = "concat(text, chr(10) || 'done' || chr(10) || 'ok' || chr(10) || 'done' || chr(10) || ' Done' || chr(10) || 'SUCCESS' || chr(10) || 'x' || chr(10) || 'success' || chr(10) || '  File \"a.py\"' || chr(10) || 'Traceback' || chr(10) || 'Success' || chr(10) || split_part(text, chr(10), 1) || chr(10) || split_part(text, chr(10), 1))"
SQL_ERROR = "(regexp_matches(lower(line), 'error|fail|traceback|exception|❌|panic|fatal') OR starts_with(t, 'File \"'))"


@query(
    f"""WITH d AS (SELECT doc_id, {LOG} AS log FROM documents), x AS (SELECT doc_id, log, unnest(range(CAST(len(string_split(log, chr(10))) AS BIGINT))) AS no, unnest(string_split(log, chr(10))) AS line FROM d),
 y AS (SELECT *, trim(line, {SQL_SPACES}) AS t FROM x), z AS (SELECT *, {SQL_ERROR} AS bad, lag(lower(t)) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM y WHERE {SQL_ERROR} OR length(t) >= 3),
 k AS (SELECT doc_id, count(*) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars, md5(string_agg(line, chr(10) ORDER BY no)) AS compressed FROM z WHERE bad OR lower(line) NOT IN ('ok', 'done', 'success') OR before IS NULL OR before <> lower(line) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(string_split(log, chr(10))) AS BIGINT) AS lines, coalesce(kept, 0) AS kept, length(log) AS original_chars, coalesce(chars, 0) AS chars, round(100E0 * coalesce(chars, 0) / greatest(length(log), 1), 6) AS ratio, compressed FROM d LEFT JOIN k USING (doc_id)"""
)
def b20_compress(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as logs, with statuses, some of them repeated, and a trace at the end."""
    logs = table(spark, folder, "documents").select("doc_id", F.expr(LOG.replace("chr(10)", "'\\n'")).alias("log"))
    kept = logs.withColumn("k", text.compressed_lines(F.col("log")))
    chars = F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    rows = kept.select("doc_id", F.size(F.split("log", "\n")).cast("long").alias("lines"), F.size("k").cast("long").alias("kept"), F.length("log").cast("long").alias("original_chars"), chars.alias("chars"), F.md5(F.array_join("k", "\n")).alias("compressed"))
    return rows.withColumn("ratio", F.round(100 * F.col("chars") / F.greatest("original_chars", F.lit(1)), 6))


WORDS, BRANDS = ["license", "version", "token", "über", "wher"], ["Brand#12", "Brand#11"]


@query(
    f"""WITH f AS (SELECT *, (id % 7) / 10E0 AS preference FROM facts WHERE archived = 0),
 w AS (SELECT id, trust_score * (1 + preference) AS w, 1 AS src FROM f WHERE {' OR '.join(f"contains(lower(fact_value), '{w}')" for w in WORDS)} ORDER BY w DESC, id LIMIT 20),
 e AS (SELECT DISTINCT f.id, trust_score AS w, 0 AS src FROM f JOIN part ON p_partkey = 1 + f.id % 97 OR p_partkey = 1 + f.id % 89 WHERE p_brand IN ('Brand#12', 'Brand#11') ORDER BY w DESC, id LIMIT 10),
 u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC) AS k FROM (SELECT * FROM w UNION ALL SELECT * FROM e) a)
 SELECT id, place, CASE src WHEN 1 THEN 'word' ELSE 'entity' END AS by FROM (SELECT *, row_number() OVER (ORDER BY src DESC, w DESC, id) AS place FROM u WHERE k = 1) p WHERE place <= 15""",
    "facts",
)
def d20_deep_search(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that hold one of several terms, by trust and preference, then those that name one of two brands."""
    facts = relation(spark, folder, "facts").withColumn("preference", (F.col("id") % 7) / 10.0)
    edges = facts.select(F.col("id").alias("fact_id"), F.explode(F.array(1 + F.col("id") % 97, 1 + F.col("id") % 89)).alias("entity_id"))
    return recall.deep_search(facts, edges, relation(spark, folder, "entities"), WORDS, BRANDS)


@query(
    """WITH t AS (SELECT user_id AS qid, session_id * 1000 + turn AS id, role, content, lower(regexp_replace(content, '[ \t\n\x0B\f\r]+', '', 'g')) AS norm,
 list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS l FROM turns),
 g AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i)[1:32] AS terms FROM t),
 m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS place, row_number() OVER (PARTITION BY qid, norm ORDER BY id) AS nth FROM g WHERE role = 'user' OR id % 7 = 0),
 h AS (SELECT *, id AS place FROM g WHERE role = 'assistant'),
 q AS (SELECT *, row_number() OVER (PARTITION BY qid, norm ORDER BY place) AS n1 FROM h WHERE len(list_intersect(terms, ['the', 'and', 'of', 'la', 'de'])) >= 2 AND NOT EXISTS (SELECT 1 FROM m WHERE m.qid = h.qid AND m.norm = h.norm AND m.norm <> '')),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS k FROM q WHERE n1 = 1 OR norm = '') x WHERE k <= 3), c AS (SELECT qid, count(*) AS n FROM f GROUP BY qid),
 r AS (SELECT m.qid, m.id, m.place, nth = 1 AND EXISTS (SELECT 1 FROM h WHERE h.qid = m.qid AND h.norm = m.norm AND h.norm <> '') AS has FROM m LEFT JOIN c ON c.qid = m.qid WHERE n IS NULL OR m.place <= greatest(0, 12 - n)), b AS (SELECT qid, count(*) AS b FROM r GROUP BY qid)
 SELECT qid, id, place, false AS verbatim, has AS has_verbatim FROM r UNION ALL SELECT f.qid, f.id, coalesce(b, 0) + k, true, false FROM f LEFT JOIN b ON b.qid = f.qid""",
    "turns",
)
def d16_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's own turns, with the answers that share words with a query; some of the turns are such answers themselves."""
    turns = relation(spark, folder, "turns").select(F.col("user_id").alias("qid"), F.expr("session_id * 1000 + turn").alias("id"), "role", "content").withColumn("place", F.col("id"))
    queries = turns.select("qid").distinct().withColumn("query", F.lit("The and, of: la de"))
    return recall.fuse_verbatim(turns.where("role = 'user' OR id % 7 = 0"), turns.where("role = 'assistant'"), queries, 12)


LEDGER = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('fact:', CAST(user_id AS STRING)) WHEN 1 THEN CAST(user_id AS STRING) ELSE concat('note:', CAST(user_id AS STRING)) END AS target_id, event_type AS action FROM events"


@query(
    f"""WITH l AS ({LEDGER.replace('STRING', 'VARCHAR')}), t AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN concat('fact:', CAST(user_id AS VARCHAR)) ELSE CAST(user_id AS VARCHAR) END AS target FROM events)
 SELECT target, event_id, target_id, action FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY event_id) AS n FROM t JOIN l ON target_id IN (target, regexp_replace(target, '^fact:', ''), 'fact:' || regexp_replace(target, '^fact:', ''))) x WHERE n <= 20"""
)
def h17_history(spark: SparkSession, folder: str) -> DataFrame:
    """The first entries of the ledger on each memory, under all its names."""
    ledger = spark.sql(LEDGER.replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))
    user = F.col("user_id").cast("string")
    targets = table(spark, folder, "events").select(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("fact:"), user)).otherwise(user).alias("target")).distinct()
    return recall.history_of(ledger, targets, 20).select("target", "event_id", "target_id", "action")


def bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as messages of their types, in fifty times as short a time, so that they come in bursts: (key, ts_s, size, seq)."""
    ts = F.col("ts").cast("timestamp").cast("double") / 50
    return table(spark, folder, "events").select(F.col("event_type").alias("key"), ts.alias("ts_s"), F.length("props").alias("size"), F.col("event_id").alias("seq"))


@query(f"WITH RECURSIVE {sql_waves('event_type', 'epoch(ts) / 50')} SELECT strftime(to_timestamp(floor(first)), '%Y-%m-%d') AS day, 'default' AS profile, reason, count(*) AS waves, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(n - 1) AS BIGINT) AS saved FROM w GROUP BY 1, 3")
def h14_coalesce_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What coalescing saves a day, by what closed the waves."""
    return coalesce.saved(coalesce.coalesce_batch(bursts(spark, folder)), "default")


@query(
    """WITH r AS (SELECT 'facts' AS name, id AS k, id AS m FROM facts UNION ALL SELECT 'types', doc_id, doc_id FROM labels UNION ALL SELECT 'raw', doc_id, doc_id FROM documents UNION ALL SELECT 'vectors', vec_id, vec_id FROM embeddings
 UNION ALL SELECT 'salience', user_id * 10 + length(event_type), user_id FROM events GROUP BY ALL UNION ALL SELECT 'verbatim', conv_id * 1000 + turn, conv_id FROM conversations UNION ALL SELECT 'queries', event_id, user_id FROM events)
 SELECT name, CAST(count(*) FILTER (m % 17 <> 3) AS BIGINT) AS rows, CAST(coalesce(sum(k) FILTER (m % 17 <> 3), 0) AS BIGINT) AS ids, CAST(count(*) FILTER (m % 17 = 3) AS BIGINT) AS stones FROM r GROUP BY name""",
    "facts",
)
def g14_cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Memories of an id with the remainder 3 by 17 gone from all seven tables, which name them in their own ways, each deleted row first kept as a tombstone."""
    of = lambda name, k, m, prefix="": table(spark, folder, name).select(F.expr(k).alias("k"), F.concat(F.lit(prefix), F.expr(m).cast("string")).alias("ref"))
    tables = {
        "facts": of("documents", "doc_id", "doc_id", "fact:"), "types": of("labels", "doc_id", "doc_id"), "raw": of("documents", "doc_id", "doc_id", "raw:"), "vectors": of("embeddings", "vec_id", "vec_id"),
        "salience": of("events", "user_id * 10 + length(event_type)", "user_id").distinct(), "verbatim": of("conversations", "conv_id * 1000 + turn", "conv_id", "verbatim:"), "queries": of("events", "event_id", "user_id"),
    }
    gone = tables["facts"].select("ref").unionByName(of("events", "user_id", "user_id").select("ref")).unionByName(of("conversations", "conv_id", "conv_id").select("ref")).unionByName(of("embeddings", "vec_id", "vec_id").select("ref"))
    gone = gone.select(F.regexp_replace("ref", "^fact:", "").alias("id")).where("CAST(id AS BIGINT) % 17 = 3").distinct()
    left, stones = lifecycle.delete_memories(tables, gone, AS_OF)
    rows = [df.select(F.lit(name).alias("name"), "k") for name, df in left.items()]
    names = spark.createDataFrame([(n,) for n in tables], "name string")
    kept = rows[0]
    for df in rows[1:]:
        kept = kept.unionByName(df)
    kept = kept.groupBy("name").agg(F.count("*").alias("rows"), F.sum("k").alias("ids"))
    counted = stones.groupBy("name").agg(F.count("*").alias("stones"))
    out = names.join(kept, "name", "left").join(counted, "name", "left")
    return out.select("name", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows", "ids", "stones")))


SAID = "concat(CASE turn % 7 WHEN 1 THEN '我们决定 ' WHEN 2 THEN '我喜欢 ' WHEN 3 THEN '我帮你部署了 ' WHEN 4 THEN '端口暴露 ' WHEN 5 THEN '反思 ' ELSE '' END, content)"
SQL_KINDS = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in rules.KINDS.items())


@query(f"SELECT session_id, turn, CASE {SQL_KINDS} ELSE 'FACTS' END AS kind FROM (SELECT session_id, turn, {SAID} AS t FROM turns) s", "turns")
def b15_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of each turn, which begins with words of one kind or none."""
    return relation(spark, folder, "turns").select("session_id", "turn", rules.first_kind(F.expr(SAID)).alias("kind"))


@query(
    """WITH d AS (SELECT doc_id, source, text, concat('raw-', substring(sha256(text), 1, 16)) AS h FROM documents), old AS (SELECT DISTINCT h FROM d WHERE doc_id % 3 = 0),
 n AS (SELECT h, min(doc_id) AS doc_id, count(*) AS seen, min(text) AS text FROM d WHERE doc_id % 3 <> 0 AND h NOT IN (SELECT h FROM old) GROUP BY h)
 SELECT concat('raw:', substring(h, 5)) AS fact_key, doc_id, seen, md5(substring(text, 1, 500)) AS value_hash, 'verbatim' AS memory_tier FROM n"""
)
def a11_raw_drawer(spark: SparkSession, folder: str) -> DataFrame:
    """Raw texts of two thirds of the documents under a key of their hash, but for those whose hash the drawer has already."""
    docs = table(spark, folder, "documents")
    drawer = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("raw-"), F.substring(F.sha2("text", 256), 1, 16), F.lit("-1")).alias("memory_id"))
    new = writes.drawer_rows(docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), drawer)
    return new.select("fact_key", F.col("id").alias("doc_id"), "seen", F.md5("fact_value").alias("value_hash"), "memory_tier")


REFS = "CASE WHEN doc_id % 3 = 0 THEN concat('fact:', CAST(doc_id AS STRING)) ELSE CAST(doc_id AS STRING) END"


@query(
    f"""WITH t AS (SELECT {REFS.replace('STRING', 'VARCHAR')} AS ref, CASE WHEN toxic = 1 THEN 'REFLECTIONS' ELSE 'DECISIONS' END AS kind FROM labels), f AS (SELECT id, CASE WHEN id % 2 = 0 THEN concat('fact:', id) ELSE CAST(id AS VARCHAR) END AS ref, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) END AS alt FROM facts)
 SELECT f.id, coalesce(a.kind, b.kind, 'FACTS') AS kind FROM f LEFT JOIN t a ON a.ref = f.ref LEFT JOIN t b ON b.ref = f.alt""",
    "facts",
)
def d17_annotate_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Results with their kind by the name of their fact, or else by their own; those of odd ids have no fact."""
    kinds = table(spark, folder, "labels").select(F.expr(REFS).alias("ref"), F.when(F.col("toxic") == 1, "REFLECTIONS").otherwise("DECISIONS").alias("kind"))
    rows = relation(spark, folder, "facts").select(F.col("id").cast("string").alias("key"), "id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("fact_id"))
    return recall.annotate_kinds(rows, kinds).select("id", "kind")


@query(
    """WITH g AS (SELECT category, count(*) AS n, max((recorded_s, id)) AS top FROM facts GROUP BY category), m AS (SELECT category FROM g WHERE n >= 3 ORDER BY category LIMIT 5)
 SELECT id, n AS group_size, category NOT IN (SELECT category FROM m) OR (recorded_s, id) = top AS keep FROM facts JOIN g USING (category)""",
    "facts",
)
def g7_keep_newest(spark: SparkSession, folder: str) -> DataFrame:
    """Of the first five sources with three memories or more only the newest memory is kept."""
    return lifecycle.keep_newest(relation(spark, folder, "facts"), "category", 3, ["recorded_s", "id"], 5).select("id", "group_size", "keep")


@query(
    """SELECT id, round(greatest(0E0, least(1E0, trust_score + CASE WHEN category IN ('src0', 'src1') THEN 0E0 WHEN id % 3 = 0 THEN 0.1E0 ELSE -0.15E0 END)), 9) AS trust, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS helpful,
 CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS unhelpful FROM facts""",
    "facts",
)
def g8_fact_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """A vote on each fact: trust rises or falls, but for facts of the first level, and the votes are counted."""
    good = F.col("id") % 3 == 0
    step = F.when(F.col("category").isin("src0", "src1"), 0.0).when(good, 0.1).otherwise(-0.15)
    trust = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust_score") + step)), 9).alias("trust")
    return relation(spark, folder, "facts").select("id", trust, good.cast("long").alias("helpful"), (~good).cast("long").alias("unhelpful"))


@query(
    """WITH s AS (SELECT *, strftime(last_access, '%Y-%m-%d') AS day FROM salience), lanes AS (SELECT day, count(*) AS lanes FROM (SELECT day, lane FROM s GROUP BY day, lane HAVING count(*) >= 3) l GROUP BY day),
 r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(CASE WHEN hit_count > 0 THEN 1E0 ELSE 0E0 END) AS rate FROM query_log GROUP BY 1),
 n AS (SELECT day, count(*) AS total, round(avg(salience), 6) AS mean, CAST(sum(CASE WHEN salience >= 0.8E0 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN salience < 0.3E0 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM s GROUP BY day)
 SELECT day, total, mean, high, low, coalesce(lanes, 0) AS lanes, round(coalesce(rate, 0), 6) AS recall_rate FROM n LEFT JOIN lanes USING (day) LEFT JOIN r USING (day) UNION ALL SELECT '2023-12-31', 7, 0.5E0, 1, 2, 3, 0.25E0""",
    "salience",
    "query_log",
)
def h4_daily_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of each day written over older rows of the same days; a day without new ones stays."""
    s, day = F.col("salience"), F.date_format("last_access", "yyyy-MM-dd")
    heat = relation(spark, folder, "salience").withColumn("day", day)
    lanes = heat.groupBy("day", "lane").agg(F.count("*").alias("n")).where("n >= 3").groupBy("day").agg(F.count("*").alias("lanes"))
    rate = relation(spark, folder, "query_log").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg((F.col("hit_count") > 0).cast("double")).alias("rate"))
    new = heat.groupBy("day").agg(F.count("*").alias("total"), F.round(F.avg(s), 6).alias("mean"), F.count_if(s >= 0.8).alias("high"), F.count_if(s < 0.3).alias("low")).join(lanes, "day", "left").join(rate, "day", "left")
    new = new.select("day", "total", "mean", "high", "low", F.coalesce("lanes", F.lit(0).cast("long")).alias("lanes"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("recall_rate"))
    first = new.agg(F.min("day").alias("day"))
    old = spark.sql("SELECT '2023-12-31' AS day, 7L AS total, 0.5D AS mean, 1L AS high, 2L AS low, 3L AS lanes, 0.25D AS recall_rate")
    old = old.unionByName(first.selectExpr("day", "0L AS total", "0D AS mean", "0L AS high", "0L AS low", "0L AS lanes", "0D AS recall_rate"))
    return writes.upsert(old, new, ["day"], ["day"]).drop("change")


@query(
    r"""WITH m AS (SELECT concat('u', CAST(conv_id % 10 AS VARCHAR)) AS user_id, concat(CASE WHEN turn % 3 = 0 THEN concat('[', role, '] ') ELSE '' END, text) AS content FROM conversations),
 t AS (SELECT 'tag' AS kind, regexp_extract(content, '^(\[[^\]]*\])', 1) AS name, count(*) AS n FROM m WHERE regexp_matches(content, '^\[[^\]]*\]') GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
 SELECT 'total' AS kind, '' AS name, count(*) AS n FROM m UNION ALL SELECT 'duplicates', '', count(*) - count(DISTINCT sha256(trim(content))) FROM m UNION ALL SELECT 'user', user_id, count(*) FROM m GROUP BY user_id UNION ALL SELECT * FROM t"""
)
def h9_store_stats(spark: SparkSession, folder: str) -> DataFrame:
    """How many memories there are, how many of them are copies, of whom they are, and the ten commonest tags that they begin with."""
    tag = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), "role", F.lit("] "))).otherwise("")
    rows = table(spark, folder, "conversations").select(F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string")).alias("user_id"), F.concat(tag, "text").alias("content"))
    hashed = rows.groupBy(F.sha2(F.trim("content"), 256).alias("h")).agg(F.count("*").alias("c"))
    row = lambda kind, name, n: (F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    both = hashed.agg(F.sum("c").alias("all"), F.count("*").alias("texts"))
    tags = rows.groupBy(F.regexp_extract("content", r"^(\[[^\]]*\])", 1).alias("tag")).agg(F.count("*").alias("c")).where("tag <> ''").orderBy(F.desc("c"), "tag").limit(10)
    users = rows.groupBy("user_id").agg(F.count("*").alias("c"))
    out = both.select(*row("total", F.lit(""), F.col("all"))).unionByName(both.select(*row("duplicates", F.lit(""), F.col("all") - F.col("texts"))))
    return out.unionByName(users.select(*row("user", F.col("user_id"), F.col("c")))).unionByName(tags.select(*row("tag", F.col("tag"), F.col("c"))))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS updates FROM events GROUP BY user_id, event_type")
def j5_latest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each job."""
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("updates"))


SQL_MOVED = f"""m AS (SELECT id, old, new, CASE new WHEN 'semantic' THEN recorded_s + 180 * 86400 WHEN 'episodic' THEN recorded_s + 30 * 86400 END AS decay_s FROM
 (SELECT id, recorded_s, CASE WHEN memory_tier IN ('procedural', 'semantic', 'episodic') THEN memory_tier ELSE 'semantic' END AS old, {SQL_TIERS} AS new FROM
 (SELECT *, lower(concat_ws(' ', category, fact_key, fact_value)) AS v FROM facts WHERE archived = 0) a) b WHERE old <> new)"""


@query(f"WITH {SQL_MOVED} SELECT id, old, new, coalesce(decay_s, -1) AS decay_s FROM m", "facts")
def f17_tier_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Live facts that their words move to another tier, with their new deadline."""
    moved = lifecycle.tier_backfill(relation(spark, folder, "facts").where("archived = 0"), TIER_WORDS)
    return moved.withColumn("decay_s", F.coalesce("decay_s", F.lit(-1)))


@query(f"WITH {SQL_MOVED} SELECT old, new, count(*) AS facts, coalesce(min(decay_s), -1) AS first_s FROM m GROUP BY old, new", "facts")
def f17_tier_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many facts would move between tiers, and when the first of them would end."""
    moved = lifecycle.tier_backfill(relation(spark, folder, "facts").where("archived = 0"), TIER_WORDS)
    return moved.groupBy("old", "new").agg(F.count("*").alias("facts"), F.coalesce(F.min("decay_s"), F.lit(-1)).alias("first_s"))


@query(
    """WITH m AS (SELECT session_id, turn, CASE (session_id + turn) % 6 WHEN 0 THEN '我叫 x' WHEN 1 THEN concat('k', CAST(turn AS VARCHAR), ' = ', role) WHEN 2 THEN '   ' ELSE content END AS c,
 CASE session_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 800 ELSE 500 END AS most FROM turns)
 SELECT session_id, turn, CASE WHEN turn % 5 = 4 THEN 'sync_path' WHEN turn % 7 = 3 THEN 'opt_out' WHEN trim(c) = '' THEN 'empty' WHEN length(trim(c)) > most THEN 'too_long'
 WHEN session_id % 4 <> 1 AND (session_id + turn) % 6 IN (0, 1) THEN 'fastpath_candidate' ELSE 'ok' END AS reason FROM m""",
    "turns",
)
def j3_should_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each turn waits in a buffer, or why not; some are short facts, some empty."""
    kind, s = (F.col("session_id") + F.col("turn")) % 6, F.col("session_id")
    pair = F.concat(F.lit("k"), F.col("turn").cast("string"), F.lit(" = "), "role")
    content = F.when(kind == 0, "我叫 x").when(kind == 1, pair).when(kind == 2, "   ").otherwise(F.col("content"))
    profile = F.when(s % 3 == 0, "tech").when(s % 3 == 1, "intimate").otherwise("other")
    reason = coalesce.buffer_reason(content, profile, F.col("turn") % 5 != 4, F.col("turn") % 7 == 3, s % 4 == 1)
    return relation(spark, folder, "turns").select("session_id", "turn", reason.alias("reason"))
