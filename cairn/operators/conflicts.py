"""Rules by which a new text ends the validity of older facts, and chains of replaced memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import bigrams
from ..sources.shared import stored
from .ordered import first_after

#: Literals of rules up to this number are broadcast.
FEW_LITERALS = 50_000
#: Seconds of a slot in which facts and the texts that end them are ordered.
SLOT = 86_400


def rule_hits(texts: DataFrame, rules: DataFrame, side: str) -> DataFrame:
    """(id, rule) for the texts (id, value) that a rule's pattern of a side finds, without regard to case.

    rules are (rule, side, pattern, literals): a text that the pattern finds holds one of the literals, of two characters at least, in lower case. A text's grams are joined to
    the first grams of the literals, so that a text meets the rules that it may fit and no other, and hundreds of rules are one join.
    """
    wanted = rules.where(F.col("side") == side).select("rule", "pattern", F.explode("literals").alias("literal"))
    wanted = wanted.withColumn("gram", F.get(bigrams(F.substring("literal", 1, 2)), F.lit(0))).where("gram IS NOT NULL")
    few = wanted.limit(FEW_LITERALS + 1).count() <= FEW_LITERALS
    rows = texts.select("id", "value", F.lower("value").alias("low"))
    found = rows.select("id", F.explode(bigrams("low")).alias("gram")).join(F.broadcast(wanted) if few else wanted, "gram").select("id", "rule", "pattern", "literal")
    met = rows.join(found, "id").where(F.contains("low", F.col("literal"))).where(F.rlike("value", F.concat(F.lit("(?i)"), F.col("pattern"))))
    return met.select("id", "rule").distinct()


def resolve_conflicts(facts: DataFrame, texts: DataFrame, rules: DataFrame) -> DataFrame:
    """What texts (id, tenant, at_s, value) end: (fact_id, closed_s, by_id, rule) for each fact (id, tenant, at_s, value, valid_to_s) that is closed.

    A text that fits the new side of a rule closes, at its own time, every fact of its tenant that fits the old side, was recorded before it (at the same time: has a smaller id) and is
    valid still. The first such text closes a fact; of rules that it fits the least is told. Null tenants are a tenant.
    """
    told = stored(rule_hits(texts, rules, "new").join(texts.select("id", "tenant", "at_s"), "id").select("tenant", "rule", "id", F.col("at_s").alias("at")), "told")
    olds = stored(rule_hits(facts, rules, "old").join(facts.select("id", "tenant", "at_s", "valid_to_s"), "id"), "olds")
    probes = olds.select("tenant", "rule", F.struct("id", "rule", "valid_to_s").alias("pid"), F.col("at_s").alias("at"), F.col("id").alias("tie"))
    met = first_after(probes, told, ["tenant", "rule"], SLOT).select("pid.*", "next")
    ended = met.where(F.col("next").isNotNull() & (F.col("valid_to_s").isNull() | (F.col("valid_to_s") > F.col("next.at"))))
    first = ended.groupBy("id").agg(F.min(F.struct("next", "rule")).alias("x"))
    return first.select(F.col("id").alias("fact_id"), F.col("x.next.at").alias("closed_s"), F.col("x.next.id").alias("by_id"), F.col("x.rule").alias("rule"))


def live_successors(edges: DataFrame) -> DataFrame:
    """States after replacements (old_id, new_id): (memory_id, state, successor) for each memory of an edge.

    A memory is superseded by the newest that replaces it, the one of greatest id, whatever its own state. Its successor is the end of its chain, found by pointer doubling. Memories that replace
    one another in a circle have no end: the greatest id of the circle is active and ends it. A memory that nothing replaces is active and its own successor.
    """
    pairs = edges.where("old_id <> new_id").groupBy(F.col("old_id").alias("id")).agg(F.max("new_id").alias("next"))
    names = edges.select(F.col("old_id").alias("id")).unionByName(edges.select(F.col("new_id").alias("id"))).distinct()
    now = stored(names.join(pairs, "id", "left").select("id", "next", F.coalesce("next", "id").alias("jump"), F.col("next").isNotNull().alias("more"), F.greatest("id", F.coalesce("next", "id")).alias("most")), "chains")
    total = now.count()
    # After k rounds jump is 2**k steps on, or the end, and most is the greatest id on the way; no chain and no circle is longer than the table.
    for _ in range(max(1, total).bit_length()):
        if not now.where("more").limit(1).count():
            break
        there = now.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("more").alias("_more"), F.col("most").alias("_most"))
        now = stored(now.join(there, "jump").select("id", "next", F.col("_jump").alias("jump"), (F.col("more") & F.col("_more")).alias("more"), F.greatest("most", "_most").alias("most")), "chains")
    # What still has more is in a circle or leads into one: most of any of its members, where the walk has gone round, is its end.
    rounds = now.where("more").select(F.col("id").alias("jump"), F.col("most").alias("round"))
    ended = now.join(rounds, "jump", "left").select("id", "next", F.when(F.col("more"), F.col("round")).otherwise(F.col("jump")).alias("successor"))
    return ended.select(F.col("id").alias("memory_id"), F.when(F.col("id") == F.col("successor"), "active").otherwise("superseded").alias("state"), "successor")
