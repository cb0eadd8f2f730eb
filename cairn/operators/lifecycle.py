"""Lifecycle: decay, eviction, expiry, merging, deletion and restoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from .ordered import clamped_sums
from .pairs import following


def decay_all(salience: DataFrame, as_of: int) -> DataFrame:
    """salience (memory_id, salience, lane, last_s, ...) with decayed and evicted: below the floor and idle for too long."""
    idle = F.greatest(F.lit(as_of) - F.col("last_s"), F.lit(0))
    out = salience.withColumn("decayed", scores.heat_decay(F.col("salience"), F.col("lane"), idle))
    return out.withColumn("evicted", (F.col("decayed") < scores.FLOOR) & (idle > scores.IDLE_DAYS * scores.DAY))


def evolution_cycle(salience: DataFrame, as_of: int) -> DataFrame:
    """Much accessed memories rise, by up to 0.05; else long idle ones fall by 0.03. Adds evolved and change."""
    rise = (F.col("access_count") >= 5) & (F.col("salience") < 0.9)
    fall = (F.col("last_s") < as_of - 14 * 86400) & (F.col("salience") > 0.25)
    step = F.when(rise, F.least(F.lit(0.05), (F.col("access_count") - 5) * 0.01)).when(fall, F.lit(-0.03)).otherwise(F.lit(0.0))
    return salience.withColumn("evolved", F.least(F.col("salience") + step, F.lit(1.0))).withColumn("change", F.when(rise, "rise").when(fall, "fall").otherwise("none"))


def feedback(salience: DataFrame, signals: DataFrame) -> DataFrame:
    """salience after signals (memory_id, seq, signal) in order: useful +0.15, useless -0.12, correction +0.05, clamped to 0.05..1 after each. Adds adjusted."""
    delta = F.when(F.col("signal") == "useful", 0.15).when(F.col("signal") == "useless", -0.12).when(F.col("signal") == "correction", 0.05).otherwise(0.0)
    runs = clamped_sums(signals.select("memory_id", "seq", delta.alias("delta")), "memory_id", "seq", "delta", 0.05, 1.0)
    runs = runs.select("memory_id", F.col("add").alias("_add"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    moved = F.least(F.col("_high"), F.greatest(F.col("_low"), F.col("salience") + F.col("_add")))
    return salience.join(runs, "memory_id", "left").withColumn("adjusted", F.coalesce(moved, "salience")).drop("_add", "_low", "_high")


def expire(facts: DataFrame, as_of: int, column: str = "valid_to_s") -> DataFrame:
    """facts with archived set where the column's time has passed; adds expired."""
    gone = F.coalesce((F.col(column) < as_of) & (F.col("archived") == 0), F.lit(False))
    return facts.withColumn("expired", gone).withColumn("archived", F.when(gone, 1).otherwise(F.col("archived")))


def keep_newest(rows: DataFrame, group: str, least: int, newest: list[str], groups: int | None = None) -> DataFrame:
    """Rows with keep and group_size: in groups of `least` rows or more, of the first `groups` by name if that is given, only the row with the greatest values of `newest` is kept. A null group is 'unknown'.

    newest ends in a unique column. A group's size and newest row are one row of an aggregate, so that no task orders a group.
    """
    named = rows.withColumn(group, F.coalesce(group, F.lit("unknown")))
    sizes = named.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("group_size"), F.max(F.struct(*newest)).alias("_top"))
    merged = sizes.where(F.col("group_size") >= least).select("_g")
    if groups is not None:
        merged = merged.orderBy("_g").limit(groups)
    told = sizes.join(merged.withColumn("_m", F.lit(True)), "_g", "left")
    joined = named.join(told, F.col(group) == F.col("_g"))
    return joined.select(*named.columns, "group_size", (F.col("_m").isNull() | (F.struct(*newest) == F.col("_top"))).alias("keep"))


def dream_merge(facts: DataFrame, since_s: int, until_s: int) -> DataFrame:
    """Active facts of a span of time in clusters of key prefix and first 30 characters: the longest value stays, ties by key, then id. Adds cluster, short, stays."""
    recent = facts.where((F.col("archived") == 0) & (F.col("recorded_s") >= since_s) & (F.col("recorded_s") <= until_s))
    placed = recent.withColumn("cluster", text.key_prefix(F.col("fact_key"))).withColumn("short", F.substring(F.lower(F.trim("fact_value")), 1, 30))
    order = Window.partitionBy("cluster", "short").orderBy(F.desc(F.length("fact_value")), "fact_key", "id")
    return placed.withColumn("stays", F.row_number().over(order) == 1)


def close_overridden(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of one key in the order of recording, then id: one that a later, different value follows is valid until then. Adds closed_s, null for those that still hold."""
    value = facts.withColumn("_h", F.sha2("fact_value", 256))
    found = following(value, keys, "recorded_s", ["_h", "recorded_s"], 86_400 * 7, "id")
    return found.withColumn("closed_s", F.when(F.col("next._h") != F.col("_h"), F.col("next.recorded_s"))).drop("_h", "next")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose `ref` is in gone (ref)."""
    return {name: df.join(gone.select("ref").distinct(), "ref", "left_anti") for name, df in tables.items()}


def delete_tenant(tables: dict[str, DataFrame], users: DataFrame, column: str = "user_id", default: str = "default", confirmed: bool = False) -> dict[str, DataFrame]:
    """Each table without the rows of the users (user_id); those of the default user only if that is confirmed. Rows of no user stay."""
    gone = users.select(F.col("user_id").alias(column)).distinct()
    if not confirmed:
        gone = gone.where(F.col(column) != default)
    return {name: df.join(gone, column, "left_anti") for name, df in tables.items()}


def conflict_events(closed: DataFrame, as_of: int) -> DataFrame:
    """An event for each fact that close_overridden closes (id, fact_key, closed_s): (target_id, event, payload, at_s)."""
    payload = F.to_json(F.struct("fact_key", "closed_s"))
    return closed.where("closed_s IS NOT NULL").select(F.concat(F.lit("fact:"), F.col("id").cast("string")).alias("target_id"), F.lit("conflict.resolved").alias("event"), payload.alias("payload"), F.lit(as_of).alias("at_s"))


def verify_lessons(heat: DataFrame, log: DataFrame) -> DataFrame:
    """heat (memory_id, salience, lane) after a look at the error log (keyword): a lesson whose keyword is still logged is fully hot; any other becomes knowledge and gains 0.05.

    heat has keyword too, the one that its lesson is about.
    """
    seen = log.select(F.lower("keyword").alias("_k")).distinct().withColumn("_s", F.lit(True))
    joined = heat.where("lane = 'lesson'").join(seen, F.lower("keyword") == F.col("_k"), "left")
    still = F.coalesce("_s", F.lit(False))
    return joined.select("memory_id", F.when(still, 1.0).otherwise(F.least(F.lit(1.0), F.col("salience") + 0.05)).alias("salience"), F.when(still, "lesson").otherwise("knowledge").alias("lane"))


def build_banks(items: DataFrame, banks: DataFrame, most: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """New versions of persona banks from items (bank, item_id, content, refs array): (bank, version, items, state), the former ready ones superseded; and the items that they hold.

    Items without a reference are left out, and of the others of a bank the first `most` by id stay. banks is (bank, version, items, state).
    """
    rank = F.row_number().over(Window.partitionBy("bank").orderBy("item_id"))
    grounded = items.where(F.size(F.coalesce("refs", F.array().cast("array<string>"))) > 0).withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn")
    last = banks.groupBy("bank").agg(F.max("version").alias("_v"))
    fresh = grounded.groupBy("bank").agg(F.count("*").alias("items")).join(last, "bank", "left")
    fresh = fresh.select("bank", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"), "items", F.lit("ready").alias("state"))
    old = banks.join(fresh.select("bank", F.lit(True).alias("_n")), "bank", "left").withColumn("state", F.when(F.coalesce("_n", F.lit(False)) & (F.col("state") == "ready"), "superseded").otherwise(F.col("state"))).drop("_n")
    return old.select("bank", "version", "items", "state").unionByName(fresh), grounded


def roll_back_banks(banks: DataFrame, wanted: DataFrame) -> DataFrame:
    """banks with the wanted (bank, version) ready in place of the version that was; a version that is not there changes nothing."""
    real = wanted.join(banks.select("bank", "version"), ["bank", "version"]).select("bank", F.col("version").alias("_w"))
    joined = banks.join(real, "bank", "left")
    state = F.when(F.col("_w").isNull(), F.col("state")).when(F.col("version") == F.col("_w"), "ready").when(F.col("state") == "ready", "superseded").otherwise(F.col("state"))
    return joined.withColumn("state", state).drop("_w")


def touch_agents(agents: DataFrame, seen: DataFrame) -> DataFrame:
    """agents (agent_id, role, last_seen_s, active) after what they sent (agent_id, seq, role, ts_s, event): the last non-empty role counts, and 'deactivate' as the last event ends it."""
    last = seen.groupBy("agent_id").agg(
        F.max_by("role", F.when(F.trim(F.coalesce("role", F.lit(""))) != "", F.col("seq"))).alias("_r"), F.max("ts_s").alias("_t"), F.max_by("event", "seq").alias("_e")
    )
    both = agents.join(last, "agent_id", "full")
    named = F.coalesce(F.nullif(F.trim("_r"), F.lit("")), F.col("role"))
    return both.select("agent_id", named.alias("role"), F.greatest("last_seen_s", "_t").alias("last_seen_s"), F.when(F.col("_e").isNull(), F.col("active")).otherwise((F.col("_e") != "deactivate").cast("int")).alias("active"))


def active_peers(agents: DataFrame, as_of: int, fresh_s: int, exclude: str | None = None) -> DataFrame:
    """Agents (agent_id, last_seen_s, active) that take part: active, seen within fresh_s, and not the one that asks."""
    live = agents.where((F.col("active") == 1) & (F.col("last_seen_s") >= as_of - fresh_s))
    return live if exclude is None else live.where(F.col("agent_id") != exclude)


def profiles_of(refs: DataFrame, agents: DataFrame, default: str = "default") -> DataFrame:
    """refs with profile, that of their agent_id in agents (agent_id, profile), or the default."""
    known = agents.select("agent_id", F.col("profile").alias("_p"))
    return refs.join(known, "agent_id", "left").withColumn("profile", F.coalesce(F.nullif("_p", F.lit("")), F.lit(default))).drop("_p")


def tombstones(rows: DataFrame, id_col: str, as_of: int) -> DataFrame:
    """A snapshot of each row as JSON, from which restore() brings it back."""
    return rows.select(F.col(id_col).alias("ref"), F.to_json(F.struct(*rows.columns)).alias("payload"), F.lit(as_of).alias("deleted_s"))


def restore(stones: DataFrame, schema) -> DataFrame:
    """The rows of tombstones, by the schema that they had."""
    return stones.select(F.from_json("payload", schema).alias("r")).select("r.*")


def tier_backfill(facts: DataFrame, table: dict[str, tuple[str, ...]], default: str = "semantic") -> DataFrame:
    """The facts (id, category, fact_key, fact_value, memory_tier, recorded_s) that their own words put in another tier: (id, old, new, decay_s).

    A null or unknown tier counts as the default. The deadline is counted from when the fact was recorded. Null words count as empty; no facts give no rows.
    """
    old = F.when(F.col("memory_tier").isin(*scores.TIERS), F.col("memory_tier")).otherwise(F.lit(default))
    new = rules.first_tier(F.concat_ws(" ", "category", "fact_key", "fact_value"), table, default)
    moved = facts.select("id", old.alias("old"), new.alias("new"), "recorded_s").where("old <> new")
    return moved.select("id", "old", "new", scores.tier_deadline(F.col("new"), F.col("recorded_s")).alias("decay_s"))


def pending(log: DataFrame) -> DataFrame:
    """Of a write-ahead log (wal_id, pos, status, ...) the entries whose latest status is 'pending': (wal_id, pos). Of several at one place the last by name counts."""
    return log.groupBy("wal_id").agg(F.max(F.struct("pos", "status")).alias("x")).where("x.status = 'pending'").select("wal_id", "x.pos")


def top_per_user(items: DataFrame, most: int, idle_s: int, as_of: int) -> DataFrame:
    """A working set: of items (user_id, ..., last_s, access_count) those not idle for too long unless accessed over twice, the latest of each user."""
    live = items.where((F.col("last_s") >= as_of - idle_s) | (F.col("access_count") > 2))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_s"), "memory_id"))
    return live.withColumn("rank", rank).where(F.col("rank") <= most)


def delete_memories(tables: dict[str, DataFrame], gone: DataFrame, as_of: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows of memories (id) under any of their names, and tombstones (name, ref, snapshot, deleted_s) of the rows that go, which are taken before.

    A table's column ref names a memory as itself, as fact:, raw: or verbatim:.
    """
    names = [F.concat(F.lit(p), F.col("id")) for p in ("", "fact:", "raw:", "verbatim:")]
    refs = gone.select(F.explode(F.array(*names)).alias("ref")).distinct()
    stones = [df.join(refs, "ref", "left_semi").select(F.lit(name).alias("name"), "ref", F.to_json(F.struct(*df.columns)).alias("snapshot"), F.lit(as_of).alias("deleted_s")) for name, df in tables.items()]
    return cascade_delete(tables, refs), reduce(DataFrame.unionByName, stones)
