"""State that is carried from row to row in order, without a window over a whole key.

What a row does to the state is made a pointer to the row that changes it next, and pointers are doubled until all rows on the way from the first are
known; or it is made a function of few numbers, and functions are composed by ranges of the order. Either way a busy key is many tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.shared import dropped, shuffled, stored
from .pairs import following

LAST = (1 << 63) - 1


def first_after(probes: DataFrame, rows: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(pid, next): for each probe (*keys, pid, at, tie) the first row (*keys, id, at) of its keys after (at, tie), as a struct (at, id); null if there is none.

    Rows are ordered by at, then id, so that a tie of LAST passes all rows of the same time and one of -1 none. Keys are cut into slots of `width`;
    a probe that finds nothing in its own slot takes the first row of the next slot that has one. Null keys are keys.
    """
    slot = F.floor(F.col("at") / width).alias("_slot")
    row = rows.select(*keys, slot, "at", F.col("id").alias("tie"), F.lit(0).alias("_kind"), F.struct("at", "id").alias("_row"), F.lit(None).cast(probes.schema["pid"].dataType).alias("pid"))
    ask = probes.select(*keys, slot, "at", "tie", F.lit(1).alias("_kind"), F.lit(None).cast(row.schema["_row"].dataType).alias("_row"), "pid")
    later = Window.partitionBy(*keys, "_slot").orderBy(F.desc("at"), F.desc("tie"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = row.unionByName(ask).withColumn("_next", F.last("_row", ignorenulls=True).over(later)).where("_kind = 1")
    slots = row.groupBy(*keys, "_slot").agg(F.min("_row").alias("_head")).unionByName(ask.select(*keys, "_slot").distinct().withColumn("_head", F.lit(None).cast(row.schema["_row"].dataType)))
    slots = slots.groupBy(*keys, "_slot").agg(F.max("_head").alias("_head"))
    others = Window.partitionBy(*keys).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_after", F.last("_head", ignorenulls=True).over(others))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*keys, "_slot"]]
    return asked.alias("a").join(shuffled(slots.alias("s")), reduce(and_, same), "left").select("a.pid", F.coalesce("a._next", "s._after").alias("next"))


def reached(nodes: DataFrame) -> DataFrame:
    """(id) of the nodes (id, next, start) that are starts, or reached from one along next; ids are unique, a null next ends a way.

    Round k takes the nodes up to 2**k steps away, so the rounds are as many as the longest way has binary digits. Each is a table in the shared folder.
    """
    now = stored(nodes.select("id", F.col("next").alias("jump"), F.col("start").alias("hit")), "reached")
    while True:
        known = now.select(F.col("id").alias("jump"), F.col("jump").alias("far"))
        new = now.where("hit AND jump IS NOT NULL").select(F.col("jump").alias("id")).distinct().withColumn("new", F.lit(True))
        step = now.join(shuffled(known), "jump", "left").join(shuffled(new), "id", "left").select("id", F.col("far").alias("jump"), (F.col("hit") | F.col("new").isNotNull()).alias("hit"), (~F.col("hit") & F.col("new").isNotNull()).alias("added"))
        after = stored(step, "reached")
        dropped(now)
        now = after.drop("added")
        now._stored = after._stored
        if not after.where("added").limit(1).count():
            return now.where("hit").select("id")


def cache_writes(requests: DataFrame, keys: list[str], ttl: float) -> DataFrame:
    """(id) of the requests (*keys, id, at) that a cache would have to make: an entry lives for ttl from its writing, whatever asks for it meanwhile.

    Requests are ordered by at, then id, which is unique. One that comes more than ttl after the one before it is made in any case; from there each
    made request points to the first one that comes more than ttl later.
    """
    requests = requests.select(*keys, "id", "at")
    follow = following(requests, keys, "at", ["id", "at"], ttl, "id")
    late = F.col("next.at") - F.col("at") > ttl
    firsts = requests.groupBy(*keys).agg(F.min(F.struct("at", "id")).alias("f")).select(F.col("f.id").alias("id"))
    starts = follow.where(late).select(F.col("next.id").alias("id")).unionByName(firsts).withColumn("start", F.lit(True))
    near = follow.where(~late).select(*keys, F.col("id").alias("pid"), (F.col("at") + ttl).alias("at"), F.lit(LAST).alias("tie"))
    pointers = first_after(near, requests, keys, ttl).select(F.col("pid").alias("id"), F.col("next.id").alias("next"))
    nodes = requests.select("id").join(pointers, "id", "left").join(starts, "id", "left").select("id", "next", F.coalesce("start", F.lit(False)).alias("start"))
    return reached(nodes)


def gate_decisions(messages: DataFrame, hot_s: float = 15, short: int = 12, query: str = "query") -> DataFrame:
    """What the relevance gate decides on each message (user_id, id, at, query) of a user in order: (id, reason, scope, needs_memory).

    The rules are those of rules.relevance, but a message under `short` characters that comes less than hot_s after a decision for memory follows it
    ('session_followup_hot'), unless it corrects or ends the talk. A decision that is carried on is not renewed; too short messages and closers decide nothing for later ones.
    """
    q = F.btrim(F.col(query), F.lit(rules.SPACES))
    judged = messages.select("user_id", "id", "at", rules.relevance(F.col(query)).alias("g"), F.length(q).alias("n")).select("user_id", "id", "at", "n", "g.reason", "g.scope")
    judged = stored(judged.withColumn("needs", F.col("scope").isNotNull()), "gate")
    sets = ~F.col("reason").isin("query_too_short", "social_closer")
    always = sets & ((F.col("reason") == "correction_detected") | (F.col("n") >= short))
    setters = judged.where(sets)
    own = lambda df: df.select("user_id", F.col("id").alias("pid"), "at", F.col("id").alias("tie"))
    no = first_after(own(setters.where("NOT needs")), setters, ["user_id"], hot_s)
    yes = setters.where("needs")
    sure = first_after(own(yes), setters.where(always), ["user_id"], hot_s)
    cool = first_after(yes.select("user_id", F.col("id").alias("pid"), (F.col("at") + hot_s).alias("at"), F.lit(-1).cast("long").alias("tie")), setters.where(~always), ["user_id"], hot_s)
    pointers = no.unionByName(sure).unionByName(cool).groupBy("pid").agg(F.min("next").alias("next")).select(F.col("pid").alias("id"), F.col("next.id").alias("next"))
    first = setters.groupBy("user_id").agg(F.min(F.struct("at", "id")).alias("f")).select(F.col("f.id").alias("id"), F.lit(True).alias("first"))
    nodes = setters.select("id", always.alias("always")).join(pointers, "id", "left").join(first, "id", "left")
    decided = reached(nodes.select("id", "next", (F.col("always") | F.col("first").isNotNull()).alias("start"))).withColumn("decided", F.lit(True))
    carried = sets & F.col("decided").isNull()
    out = judged.join(decided, "id", "left")
    value = lambda hot, column: F.when(carried, F.lit(hot)).otherwise(F.col(column))
    return out.select("id", value("session_followup_hot", "reason").alias("reason"), value("episode", "scope").alias("scope"), value(True, "needs").alias("needs_memory"))


#: Sequence numbers of a range whose steps are composed at once.
RANGE = 256


def clamped_sums(steps: DataFrame, key: str, seq: str, delta: str, low: float, high: float) -> DataFrame:
    """(key, add, low, high): what steps (key, seq, delta), each x -> min(high, max(low, x + delta)), do to x in the order of seq, which is a unique integer of a key.

    Any run of such steps is again one, x -> min(high, max(low, x + add)). Runs are composed by ranges of RANGE numbers, then ranges of ranges, so that no
    array is longer than RANGE and a key of any length is many tasks.
    """
    at = F.col(seq).cast("long")
    runs = steps.select(F.col(key), at.alias("_at"), F.col(delta).cast("double").alias("add"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    clamp = lambda x, f: F.least(f["high"], F.greatest(f["low"], x + f["add"]))
    after = lambda f, g: F.struct((f["add"] + g["add"]).alias("add"), clamp(f["low"], g).alias("low"), clamp(f["high"], g).alias("high"))
    first, last = runs.agg(F.min("_at"), F.max("_at")).first()
    if first is None:
        return runs.select(key, "add", "low", "high")
    runs = runs.withColumn("_at", F.col("_at") - first)
    last -= first
    while True:
        if not last:
            return runs.select(key, "add", "low", "high")
        last //= RANGE
        parts = runs.groupBy(key, F.floor(F.col("_at") / RANGE).alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_at", F.struct("add", "low", "high").alias("f")))).alias("x"))
        fold = F.aggregate(F.slice("x", 2, RANGE), F.get("x", F.lit(0))["f"], lambda f, x: after(f, x["f"]))
        runs = stored(parts.select(key, "_at", fold.alias("f")).select(key, "_at", "f.*"), "runs")

