"""Writing: duplicates, merges, upserts, votes, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from ..functions.grams import bigrams
from ..sources.shared import stored
from .matches import best_match
from .ordered import cache_writes


def check_duplicate(new: DataFrame, old: DataFrame, latest: int | None = None, merge: float = 0.85, update: float = 0.70) -> DataFrame:
    """For each new fact the most similar old one of its agent and category, by bigrams of whole values: (id, match_id, similarity, action).

    Both have id, agent_id, category, fact_value; old has recorded_s if only the latest of each agent and category should be looked at. merge and
    update are the least similarities for these actions; else the fact is inserted, similarity is 0 and match_id null. Of equally similar
    facts that of least id.
    """
    block = ["agent_id", "category"]
    if latest is not None:
        rank = F.row_number().over(Window.partitionBy(*block).orderBy(F.desc("recorded_s"), F.desc("id")))
        old = old.withColumn("_rn", rank).where(F.col("_rn") <= latest)
    left = new.select("id", *block, bigrams("fact_value").alias("grams"), F.lit(None).cast("long").alias("before"))
    right = old.select(F.col("id").alias("match_id"), *block, bigrams("fact_value").alias("grams"), F.col("id").alias("at"))
    best = best_match(left, right, block, update)
    out = new.select("id").join(best, "id", "left").select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "match_id")
    return out.withColumn("action", F.when(F.col("similarity") >= merge, "merge").when(F.col("similarity") >= update, "update").otherwise("insert"))


def merge_values(pairs: DataFrame) -> DataFrame:
    """pairs (id, old_value, new_value, old_tags, new_tags) merged: (id, fact_value, summary, tags). The longer value stays, on a tie the old one; tags are united in order."""
    value = F.when(F.length(F.coalesce("old_value", F.lit(""))) >= F.length(F.coalesce("new_value", F.lit(""))), F.col("old_value")).otherwise(F.col("new_value"))
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    tags = F.array_join(F.array_distinct(F.concat(split("old_tags"), split("new_tags"))), ",")
    return pairs.select("id", value.alias("fact_value"), F.substring(value, 1, 60).alias("summary"), tags.alias("tags"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list, keep_old: list[str] = ()) -> DataFrame:
    """old with new's rows by key: of new rows of one key the first by the order; columns in keep_old keep the old value where the new one is null."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    latest = new.withColumn("_rn", rank).where("_rn = 1").drop("_rn").withColumn("_new", F.lit(True))
    both = old.withColumn("_old", F.lit(True)).alias("o").join(latest.alias("n"), keys, "full")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old else F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys], F.when(F.col("_new") & F.col("_old"), "updated").when(F.col("_new"), "inserted").otherwise("kept").alias("change"))


def store_turns(turns: DataFrame) -> DataFrame:
    """One row per user, content hash and session: its first turn, occurrences, first and last time. Empty contents are not stored."""
    hashed = turns.withColumn("content_hash", text.content_hash(F.col("content"))).where("content_hash <> ''")
    return hashed.groupBy("user_id", "session_id", "content_hash").agg(
        F.min("turn").alias("first_turn"), F.count("*").alias("occurrences"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s")
    )


def aggregate_opinions(opinions: DataFrame) -> DataFrame:
    """Facts with two or more sources: the stance of most votes with its mean confidence; on a tie neutral, with the mean of neutral votes or 0.5.

    (fact_id, stance, confidence, votes). Confidences are clamped to 0..1.
    """
    clean = opinions.withColumn("confidence", F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    per = clean.groupBy("fact_id", "stance").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    per = per.groupBy("fact_id").agg(F.collect_list(F.struct("stance", "n", "mean")).alias("all"), F.sum("n").alias("votes")).where("votes >= 2")  # three stances at most
    most = F.array_max(F.transform("all", lambda x: x["n"]))
    top = F.filter("all", lambda x: x["n"] == most)
    neutral = F.filter("all", lambda x: x["stance"] == "neutral")
    stance = F.when(F.size(top) == 1, F.get(top, F.lit(0))["stance"]).otherwise(F.lit("neutral"))
    mean = F.when(F.size(top) == 1, F.get(top, F.lit(0))["mean"]).otherwise(F.coalesce(F.get(neutral, F.lit(0))["mean"], F.lit(0.5)))
    return per.select("fact_id", stance.alias("stance"), mean.alias("confidence"), "votes")


def review(candidates: DataFrame, verdicts: DataFrame, sure: float = 0.9, automatic: tuple[str, ...] = ("偏好", "preference", "preferences")) -> DataFrame:
    """Pending candidates (candidate_id, category, status) after verdicts (candidate_id, verdict, confidence), which any evaluator may give.

    No verdict leaves the candidate as it is; 'reject' rejects; 'approve' commits only a sure verdict in an automatic category, else the candidate is evaluated and
    waits for a person. Decided candidates never change.
    """
    joined = candidates.join(verdicts, "candidate_id", "left")
    commits = (F.col("verdict") == "approve") & (F.col("confidence") >= sure) & F.col("category").isin(*automatic)
    after = F.when((F.col("status") != "pending") | F.col("verdict").isNull(), F.col("status")).when(F.col("verdict") == "reject", "rejected").when(commits, "committed").otherwise("evaluated")
    return joined.withColumn("status", after).select(*candidates.columns)


#: Trust of facts that wait for review, and of approved ones.
PROVISIONAL, APPROVED = 0.30, 0.50


def govern(facts: DataFrame) -> DataFrame:
    """Each fact (id, category, fact_key, fact_value) after screening: (id, route, status, archived, trust).

    'reject' archives the fact and leaves trust as it was (null); 'human_review' and 'llm_eval' make it a pending candidate of provisional trust.
    """
    verdict = rules.screen(F.concat_ws(" ", "fact_key", "fact_value"))
    gone = F.startswith("verdict", F.lit("reject"))
    route = F.when(gone, "rule_rejected").when(F.col("verdict") == "human_review", "human_review").otherwise("llm_eval")
    rows = facts.select("id", verdict.alias("verdict"))
    return rows.select("id", route.alias("route"), F.when(gone, "rejected").otherwise("pending").alias("status"), gone.cast("int").alias("archived"), F.when(~gone, F.lit(PROVISIONAL)).alias("trust"))


def rejection_stones(rejected: DataFrame, as_of: int) -> DataFrame:
    """Tombstones of rejected facts (fact_key, category, fact_value, user_id, reason, actor): (target_id, target_type, user_id, snapshot, reason, actor, deleted_s)."""
    snapshot = F.to_json(F.struct("category", "fact_key", "fact_value"))
    return rejected.select(F.concat(F.lit("fact:"), "fact_key").alias("target_id"), F.lit("fact").alias("target_type"), "user_id", snapshot.alias("snapshot"), "reason", "actor", F.lit(as_of).alias("deleted_s"))


def ledger(events: DataFrame, action: str, as_of: int) -> DataFrame:
    """Entries of the event ledger for events (actor, target_id, reason, value): (actor, action, target_id, reason, after_hash, at_s)."""
    return events.select("actor", F.lit(action).alias("action"), "target_id", "reason", text.content_hash(F.col("value")).alias("after_hash"), F.lit(as_of).alias("at_s"))


def review_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates (candidate_id, status, trust, archived) after a person's decisions (candidate_id, decision): approve commits and restores trust, reject archives.

    Only pending and evaluated candidates change; other words decide nothing. Adds detail: decided, ignored or null without a decision. Of several
    decisions on one candidate the least word counts.
    """
    one = decisions.select("candidate_id", F.lower(F.trim("decision")).alias("decision")).groupBy("candidate_id").agg(F.min("decision").alias("decision"))
    joined = candidates.join(one, "candidate_id", "left")
    open_ = F.col("status").isin("pending", "evaluated") & F.col("decision").isin("approve", "reject")
    yes, no = F.coalesce(open_ & (F.col("decision") == "approve"), F.lit(False)), F.coalesce(open_ & (F.col("decision") == "reject"), F.lit(False))
    return joined.select(
        "candidate_id", F.when(yes, "committed").when(no, "rejected").otherwise(F.col("status")).alias("status"), F.when(yes, APPROVED).otherwise(F.col("trust")).alias("trust"),
        F.when(no, 1).otherwise(F.col("archived")).alias("archived"), F.when(yes | no, "decided").when(F.col("decision").isNotNull(), "ignored").alias("detail"),
    )


def write_facts(new: DataFrame, old: DataFrame, as_of: int, tier_words: dict[str, tuple[str, ...]]) -> DataFrame:
    """What becomes of each new fact (id, agent_id, category, fact_key, fact_value, memory_tier): (id, action, fact_id, memory_tier, decay_s, fact_value, route, trust, archived).

    Guarded facts end as 'error'. Others are compared with old facts (id, agent_id, category, fact_value): a duplicate is merged into that fact (the
    longer value) or updates it, and keeps its deadline (null); the rest is inserted with the tier's deadline and screened. Nothing is compared within the batch.
    """
    defaulted = lambda c, d: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", d).otherwise(F.trim(c))
    clean = new.select("id", defaulted("agent_id", F.lit("local")).alias("agent_id"), defaulted("category", F.lit("general")).alias("category"), F.trim("fact_key").alias("fact_key"), F.trim("fact_value").alias("raw"), "memory_tier")
    clean = clean.withColumn("told", F.when(F.coalesce("fact_key", F.lit("")) == "", "empty").otherwise(rules.guard(F.col("raw")))).withColumn("fact_value", rules.cleaned(F.col("raw")))
    clean = stored(clean.drop("raw"), "clean")  # what the guard tells is read four times
    good = clean.where("told = 'ok'")
    tier = F.coalesce("memory_tier", rules.first_tier(F.concat_ws(" ", "category", "fact_key", "fact_value"), tier_words))
    days = scores.choose(F.col("tier"), {k: int(v[1]) for k, v in scores.TIERS.items() if v[1]}, None)
    found = check_duplicate(good, old).select("id", "match_id", "action")
    placed = good.withColumn("tier", tier).join(found, "id").join(old.select(F.col("id").alias("match_id"), F.col("fact_value").alias("old_value")), "match_id", "left")
    inserts = F.col("action") == "insert"
    value = F.when((F.col("action") == "merge") & (F.length("old_value") >= F.length("fact_value")), F.col("old_value")).otherwise(F.col("fact_value"))
    governed = govern(good).select("id", "route", "trust", "archived")
    done = placed.join(governed, "id").select(
        "id", "action", F.coalesce("match_id", "id").alias("fact_id"), F.col("tier").alias("memory_tier"), F.when(inserts, as_of + days * 86400).cast("long").alias("decay_s"), value.alias("fact_value"),
        F.when(inserts, F.col("route")).alias("route"), F.when(inserts, F.col("trust")).alias("trust"), F.when(inserts, F.col("archived")).alias("archived"),
    )
    errors = clean.where("told <> 'ok'").select("id", F.lit("error").alias("action"), *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in done.columns[2:]])
    return done.unionByName(errors)


def put_blocks(old: DataFrame, new: DataFrame, keys: list[str], as_of: int, shortest: int = 10, longest: int = 600) -> DataFrame:
    """Core blocks (block_key, content, updated_s, verified_s) after new ones (block_key, content, seq): the last good one of each key replaces the old; a null content only verifies.

    Good are known keys with contents of a length within bounds. Verifying an unknown block does nothing.
    """
    known = new.where(F.col("block_key").isin(*keys)).withColumn("content", F.trim("content"))
    good = known.where(F.length("content").between(shortest, longest)).groupBy("block_key").agg(F.max_by("content", "seq").alias("new_content"))
    seen = known.where(F.col("content").isNull() | F.length("content").between(shortest, longest)).select("block_key").distinct().withColumn("seen", F.lit(True))
    both = old.join(good, "block_key", "full").join(seen, "block_key", "left")
    fresh = F.col("new_content").isNotNull()
    return both.select(
        "block_key", F.coalesce("new_content", "content").alias("content"), F.when(fresh, F.lit(as_of)).otherwise(F.col("updated_s")).alias("updated_s"),
        F.when(F.coalesce("seen", F.lit(False)), F.lit(as_of)).otherwise(F.col("verified_s")).alias("verified_s"),
    )


def write_checkpoints(old: DataFrame, new: DataFrame, keys: list[str], as_of: int, longest: int = 600) -> DataFrame:
    """Checkpoints (session_id, block_key, content, created_s): a session that is written anew loses its old blocks; contents of three characters or more stay, cut, under known keys."""
    named = new.withColumn("session_id", F.trim("session_id")).where(F.length("session_id") >= 3)
    kept = named.where(F.col("block_key").isin(*keys) & (F.length(F.trim("content")) >= 3))
    fresh = kept.select("session_id", "block_key", F.substring(F.trim("content"), 1, longest).alias("content"), F.lit(as_of).alias("created_s"))
    return old.join(named.select("session_id").distinct(), "session_id", "left_anti").unionByName(fresh)


def record_types(types: DataFrame, refs: DataFrame, table: dict[str, str]) -> DataFrame:
    """types (ref, kind) with the kinds of refs (ref, content) by the first pattern that fits: new refs are added, known ones take the new kind."""
    fresh = refs.groupBy("ref").agg(F.max("content").alias("content")).select("ref", rules.first_kind(F.coalesce("content", F.lit("")), table).alias("kind"))
    return types.join(fresh, "ref", "left_anti").unionByName(fresh)


def types_of(refs: DataFrame, types: DataFrame, default: str = "FACTS") -> DataFrame:
    """refs (ref, ref_alt) with kind: of ref, else of ref_alt, else the default."""
    alt = types.select(F.col("ref").alias("ref_alt"), F.col("kind").alias("alt_kind"))
    return refs.join(types, "ref", "left").join(alt, "ref_alt", "left").select("ref", "ref_alt", F.coalesce("kind", "alt_kind", F.lit(default)).alias("kind"))


def grow_skills(trajectories: DataFrame, existing: DataFrame, least: int = 4) -> DataFrame:
    """Drafts from trajectories (task, steps) of at least so many steps: (skill_name, trigger_rule, procedure, candidate_count, change).

    Drafts of one name: that of most steps, then of least task. An existing skill (skill_name, status) that is no draft any more is never overwritten: change is 'skipped', else
    'updated' or 'inserted'.
    """
    steps = F.filter(F.transform("steps", lambda s: F.trim(s)), lambda s: s != "")
    rows = trajectories.withColumn("steps", steps).where(F.size("steps") >= least)
    task = F.coalesce(F.nullif(F.trim("task"), F.lit("")), F.lit("task-skill"))
    trigger = F.concat(F.lit("当需要处理「"), F.coalesce(F.nullif(F.trim("task"), F.lit("")), F.lit("类似任务")), F.lit("」时触发"))
    rows = rows.select("task", text.slug(F.substring(F.lower(task), 1, 40)).alias("skill_name"), trigger.alias("trigger_rule"), "steps")
    best = rows.groupBy("skill_name").agg(F.min(F.struct((-F.size("steps")).alias("n"), "task", "trigger_rule", "steps")).alias("x"))
    document = text.skill_document(F.col("skill_name"), F.col("x.trigger_rule"), F.slice("x.steps", 1, least + 4), F.array(F.lit("本草稿由规则降级生成，需人工审核")))
    joined = best.join(existing, "skill_name", "left")
    change = F.when(F.col("status").isNull(), "inserted").when(F.col("status") == "draft", "updated").otherwise("skipped")
    return joined.select("skill_name", F.col("x.trigger_rule").alias("trigger_rule"), document.alias("procedure"), F.size("x.steps").alias("candidate_count"), change.alias("change"))


def save_insights(new: DataFrame, old: DataFrame, default_user: str) -> DataFrame:
    """The insights (user_id, content, confidence) that are added to old ones (user_id, content): guarded, cleaned, and not stored yet under any name that the user sees. One of equal ones, with the greatest confidence.

    Confidence is clamped to 0..1, and 0.5 where it is missing.
    """
    content = rules.cleaned(F.trim("content"))
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    good = new.where((F.trim(F.coalesce("content", F.lit(""))) != "") & (rules.guard(F.trim("content")) == "ok"))
    rows = good.select("user_id", content.alias("content"), sure.alias("confidence")).groupBy("user_id", "content").agg(F.max("confidence").alias("confidence"))
    stored = old.select("user_id", "content").distinct()
    if default_user != "default":  # its rows were once written under the literal name
        stored = stored.unionByName(stored.where("user_id = 'default'").select(F.lit(default_user).alias("user_id"), "content"))
    return rows.join(stored, ["user_id", "content"], "left_anti")


def add_seeds(have: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """have with the seeds whose key it lacks."""
    return have.unionByName(seeds.join(have.select(key), key, "left_anti").select(have.columns))


def checkpoint_of(checkpoints: DataFrame) -> DataFrame:
    """Each session's blocks (session_id, block_key, content, created_s) as a map: (session_id, blocks, created_s)."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_key", "content"))))  # few blocks a session
    return checkpoints.groupBy("session_id").agg(entries.alias("blocks"), F.min("created_s").alias("created_s"))


def self_edit(pairs: DataFrame, verdicts: DataFrame, least: float = 0.25) -> DataFrame:
    """Edits that verdicts (id, verdict, merged) on pairs (id, memory_id, old_text, new_text) make: (edit_id, memory_id, action, old_text, new_text).

    A duplicate keeps the longer text, a conflict takes the merged one or else the new; distinct ones, and pairs whose words are less alike than `least`, are no edits.
    """
    joined = pairs.join(verdicts, "id").where(text.jaccard(text.words(F.col("old_text")), text.words(F.col("new_text"))) >= least)
    longer = F.when(F.length("new_text") > F.length("old_text"), F.col("new_text")).otherwise(F.col("old_text"))
    after = F.when(F.col("verdict") == "duplicate", longer).otherwise(F.coalesce("merged", "new_text"))
    return joined.where(F.col("verdict").isin("duplicate", "conflict")).select(F.col("id").alias("edit_id"), "memory_id", F.col("verdict").alias("action"), "old_text", after.alias("new_text"))


def roll_back(edits: DataFrame) -> DataFrame:
    """The text that undoing the latest edit of each memory (edit_id, memory_id, undone, old_text) brings back: (memory_id, edit_id, restored)."""
    return edits.where("undone = 0").groupBy("memory_id").agg(F.max("edit_id").alias("edit_id"), F.max_by("old_text", "edit_id").alias("restored"))


def update_contents(tables: dict[str, DataFrame], updates: DataFrame, column: str = "content") -> dict[str, DataFrame]:
    """Each table (ref, owner, column, ...) with the contents of updates (ref, owner, value): rows of a ref whose owner is the update's, or any where that is null."""
    out = {}
    for name, df in tables.items():
        joined = df.join(updates.select("ref", F.col("owner").alias("_o"), F.col("value").alias("_v"), F.lit(True).alias("_u")), "ref", "left")
        mine = F.coalesce("_u", F.lit(False)) & (F.col("_o").isNull() | F.col("_o").eqNullSafe(F.col("owner")))
        out[name] = joined.withColumn(column, F.when(mine, F.col("_v")).otherwise(F.col(column))).select(df.columns)
    return out


def add_missing(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """df with the columns that it lacks, each with its default for all rows; those that it has stay as they are."""
    return df.withColumns({n: F.lit(v) for n, v in columns.items() if n not in df.columns})


def layer_add(new: DataFrame, nearest: DataFrame, counts: DataFrame, capacity: int = 1_000, full: float = 0.8, alike: float = 0.85) -> DataFrame:
    """How new memories (id, user_id, content) are added: (id, user_id, action, existing_id).

    nearest (id, memory_id, content) is the best hit of each in the store; where the first 200 characters of both are alike, that memory is updated. Else the memory is new,
    and 'merged' where the user's count of memories (user_id, memories) has reached its share of the capacity, so that similar ones are to be merged first.
    """
    head = lambda c: text.grams(F.substring(c, 1, 200))
    hits = nearest.select("id", "memory_id", F.col("content").alias("old"))
    joined = new.join(hits, "id", "left").join(counts, "user_id", "left")
    same = F.coalesce(text.jaccard(head(F.col("content")), head(F.col("old"))) > alike, F.lit(False))
    action = F.when(same, "updated").when(F.coalesce("memories", F.lit(0)) >= full * capacity, "merged").otherwise("new")
    return joined.select("id", "user_id", action.alias("action"), F.when(same, F.col("memory_id")).alias("existing_id"))


def fast_add(messages: DataFrame, seen: DataFrame, ttl_s: int) -> DataFrame:
    """The way of each message (seq, key, ts_s, content) into the store: (seq, way): 'cached', 'duplicate', 'fast' or 'extract', the first that holds.

    Cached: the same content of the key was extracted no more than ttl_s before; an entry lives from its writing, and a later request doesn't renew it. Duplicate: the
    store, seen (key, content_hash), has it. Fast: the text is of a form that needs no model. seq is unique.
    """
    rows = messages.withColumn("content_hash", text.content_hash(F.col("content")))
    made = cache_writes(rows.select("key", "content_hash", F.col("seq").alias("id"), F.col("ts_s").alias("at")), ["key", "content_hash"], ttl_s).select(F.col("id").alias("seq"), F.lit(True).alias("made"))
    known = seen.select("key", "content_hash").distinct().withColumn("stored", F.lit(True))
    joined = rows.join(known, ["key", "content_hash"], "left").join(made, "seq", "left")
    return joined.select("seq", F.when(F.col("made").isNull(), "cached").when(F.coalesce("stored", F.lit(False)), "duplicate").when(text.fastpath(F.col("content")).isNotNull(), "fast").otherwise("extract").alias("way"))


#: Fixed values of the raw drawer: digits of the hash that a text is known by, and the characters of it that its fact shows.
RAW_DIGITS, RAW_SHOWN = 16, 500


def drawer_rows(new: DataFrame, drawer: DataFrame) -> DataFrame:
    """Facts of raw texts (id, content) that no memory of the drawer (memory_id, raw-<hash> and more) has: (fact_key, id, seen, fact_value, memory_tier), once a text, of the least id."""
    mark = F.concat(F.lit("raw-"), F.substring(F.sha2("content", 256), 1, RAW_DIGITS))
    held = drawer.where(F.startswith("memory_id", F.lit("raw-"))).select(F.substring("memory_id", 1, 4 + RAW_DIGITS).alias("mark")).distinct()
    fresh = new.where("content IS NOT NULL").withColumn("mark", mark).join(held, "mark", "left_anti").groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("seen"), F.min(F.substring("content", 1, RAW_SHOWN)).alias("fact_value"))
    return fresh.select(F.concat(F.lit("raw:"), F.substring("mark", 5, RAW_DIGITS)).alias("fact_key"), "id", "seen", "fact_value", F.lit("verbatim").alias("memory_tier"))
