"""Comparing facts with facts: conflicts, contradictions, scenes, patterns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.grams import bigrams
from .similar import best_similar


def conflicts(rows: DataFrame, rules: list[tuple[str, str]], group: str, text_col: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Conflicts within a group: two rows of which one has a rule's first word and the other its second. As members (id, g, words) and classes (g, words, other, rule, n).

    Rows with the same rule words (a number, two bits a rule) are one class: classes has each ordered pair of classes of a group in conflict, with the least rule that
    sets them apart and the number n of rows of the other. Rows without a rule's word are no members. So the output does not grow with the pairs. A class may be in
    conflict with itself, and n then counts the row itself too.
    """
    bits = [F.when(F.contains(text_col, F.lit(w)), F.lit(1 << (2 * k + s))).otherwise(F.lit(0)) for k, r in enumerate(rules) for s, w in enumerate(r)]
    words = sum(bits[1:], bits[0]).cast("long")
    members = rows.select(F.col(id_col).alias("id"), F.col(group).alias("g"), words.alias("words")).where("words > 0")
    counts = members.groupBy("g", "words").agg(F.count("*").alias("n"))
    a, b = counts.alias("a"), counts.alias("b")
    has = lambda side, k, s: F.col(f"{side}.words").bitwiseAND(F.lit(1 << (2 * k + s))) != 0
    rule = F.coalesce(*[F.when((has("a", k, 0) & has("b", k, 1)) | (has("a", k, 1) & has("b", k, 0)), F.lit(k)) for k in range(len(rules))])
    pairs = a.join(b, F.col("a.g") == F.col("b.g")).select("a.g", F.col("a.words").alias("words"), F.col("b.words").alias("other"), rule.alias("rule"), F.col("b.n").alias("n"))
    return members, pairs.where("rule IS NOT NULL")


def conflict_counts(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows that are in conflict with each member, itself excluded, and the least rule: (id, conflicts, rule); members without any are left out."""
    own = F.when(F.col("words") == F.col("other"), F.col("n") - 1).otherwise(F.col("n"))
    per = classes.withColumn("n", own).where("n > 0").groupBy("g", "words").agg(F.sum("n").alias("conflicts"), F.min("rule").alias("rule"))
    return members.join(per, ["g", "words"]).select("id", "conflicts", "rule")


def penalise(salience: DataFrame, counts: DataFrame, factor: float = 0.5) -> DataFrame:
    """salience (id, salience) times the factor for every conflict that a row is part of, by counts (id, conflicts). Adds penalised."""
    joined = salience.join(counts.select("id", F.col("conflicts").alias("_k")), "id", "left")
    return joined.withColumn("penalised", F.col("salience") * F.pow(F.lit(factor), F.coalesce("_k", F.lit(0)))).drop("_k")


def latest_of(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first rows of each group by the order, with their place rn."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= most)


def following(rows: DataFrame, group: list[str], order: str, carry: list[str], width: int = 4_096, tie: str | None = None) -> DataFrame:
    """rows with next: a struct of carry of the following row of the group by the numbers in order, then tie; null for the last.

    A group is cut into slots of `width` numbers. A slot knows the first row of the slot after it, so that no task orders a whole group.
    """
    value = F.struct(*carry)
    by = [order] if tie is None else [order, tie]
    slotted = rows.withColumn("_slot", F.floor(F.col(order) / width))
    inside = slotted.withColumn("_next", F.lead(value).over(Window.partitionBy(*group, "_slot").orderBy(*by)))
    heads = slotted.groupBy(*group, "_slot").agg(F.min_by(value, F.struct(*by)).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(*group).orderBy("_slot"))).drop("_head")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*group, "_slot"]]
    joined = inside.alias("r").join(heads.alias("h"), reduce(and_, same))
    return joined.select(*[f"r.{c}" for c in rows.columns], F.coalesce("r._next", "h._after").alias("next"))


def contradictions(facts: DataFrame, entity_terms, least_overlap: float = 0.3, least: float = 0.15, latest: int = 50) -> DataFrame:
    """Pairs of a category's latest facts that speak of the same entities in other words: (a, b, entity_overlap, score).

    score = overlap of entities * (1 - Jaccard of word tokens). entity_terms is a function from the value's column to an array.
    """
    value = F.col("fact_value")
    rows = latest_of(facts, "category", [F.desc("recorded_s"), F.desc("id")], latest)
    rows = rows.select("id", "category", entity_terms(value).alias("entities"), text.matches(F.lower(value), "[a-z]{2,}").alias("tokens"))
    l, r = rows.alias("l"), rows.alias("r")
    pairs = l.join(r, (F.col("l.category") == F.col("r.category")) & (F.col("l.id") < F.col("r.id")))
    same = text.jaccard(F.col("l.entities"), F.col("r.entities"))
    pairs = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), same.alias("entity_overlap"), (same * (1 - text.jaccard(F.col("l.tokens"), F.col("r.tokens")))).alias("score"))
    return pairs.where((F.col("entity_overlap") >= least_overlap) & (F.col("score") >= least))


def scenes(facts: DataFrame, latest: int = 100, least: float = 0.25) -> DataFrame:
    """Each of a category's latest facts with the most similar one before it, the earliest of equal ones: (category, id, match_id, similarity)."""
    rows = latest_of(facts, "category", [F.desc("recorded_s"), F.desc("id")], latest).select("category", "id", "rn", bigrams("fact_value").alias("grams"))
    left = rows.select("id", "category", "grams", F.col("rn").alias("before"))
    right = rows.select(F.col("id").alias("match_id"), "category", "grams", F.col("rn").alias("at"))
    return best_similar(left, right, ["category"], least).join(rows.select("id", "category"), "id").select("category", "id", "match_id", "similarity")


#: Fixed words of evolution: what says that a fact is replaced, words for and against, and topics that are none.
REPLACES = ("改为", "取代", "更新为", "不用了", "废弃", "修改为", "修正为", "现在是", "而不是")
FOR = ("use", "choose", "select", "recommend", "best", "optimal", "采用", "使用", "推荐")
AGAINST = ("avoid", "not", "never", "wrong", "deprecated", "不要", "不应", "避免")
NO_TOPICS = ("user", "AI", "现在", "改为", "喜欢", "不再", "决定", "已经", "为了")


def evolution(near: DataFrame, least: float = 0.12) -> DataFrame:
    """Edges of how new facts change old ones, for pairs near (old_id, new_id, old_text, new_text): (old_id, new_id, relation, similarity).

    Pairs are related by grams and words, or by a common CJK topic. A new text that says so, or that is for what the old one is against, 'replaces' it; else it 'enriches' it.
    """
    old, new = F.col("old_text"), F.col("new_text")
    similarity = text.gram_word_jaccard(text.gram_sets(old), text.gram_sets(new))
    topics = lambda c: F.array_except(text.matches(c, "[一-鿿]{2,}"), F.array(*map(F.lit, NO_TOPICS)))
    some = lambda c, words: reduce(or_, (F.contains(c, F.lit(w)) for w in words))
    flips = (some(F.lower(old), FOR) & some(F.lower(new), AGAINST)) | (some(F.lower(old), AGAINST) & some(F.lower(new), FOR))
    rows = near.where("old_id <> new_id AND old_text <> ''").withColumn("similarity", similarity)
    related = rows.where((F.col("similarity") >= least) | F.arrays_overlap(topics(old), topics(new)))
    return related.select("old_id", "new_id", F.when(some(new, REPLACES) | flips, "replaces").otherwise("enriches").alias("relation"), "similarity")


def crystallise(facts: DataFrame, as_of: int, excluded: list[str], least: int = 3, most: int = 20) -> DataFrame:
    """Categories with several distinct keys still valid: (category, keys, newest_s), those with most keys first."""
    live = facts.where((F.col("archived") == 0) & (F.col("valid_to_s").isNull() | (F.col("valid_to_s") >= as_of)) & ~F.col("category").isin(excluded))
    grouped = live.groupBy("category").agg(F.count_distinct("fact_key").alias("keys"), F.max("recorded_s").alias("newest_s")).where(F.col("keys") >= least)
    return grouped.orderBy(F.desc("keys"), "category").limit(most)


def use_crystals(crystals: DataFrame, uses: DataFrame, least: int = 3, worst: float = 0.34) -> DataFrame:
    """crystals (crystal_id, status, uses, successes) after uses (crystal_id, success): counters rise, and an approved one that was used enough with too few successes is archived."""
    more = uses.groupBy("crystal_id").agg(F.count("*").alias("_u"), F.count_if(F.col("success")).alias("_s"))
    joined = crystals.join(more, "crystal_id", "left").withColumns({"uses": F.col("uses") + F.coalesce("_u", F.lit(0)), "successes": F.col("successes") + F.coalesce("_s", F.lit(0))})
    poor = (F.col("status") == "approved") & (F.col("uses") >= least) & (F.col("successes") / F.greatest("uses", F.lit(1)) < worst)
    return joined.withColumn("status", F.when(poor, "archived").otherwise(F.col("status"))).select(crystals.columns)


def instincts(memories: DataFrame, least: int = 3, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Categories with enough memories (memory_id, category, source, content), by category, else source, else 'general', each with its first contents; and the memories that these leave.

    (category, memories, examples), and memories without those that went into one.
    """
    named = memories.withColumn("_c", F.coalesce("category", "source", F.lit("general")))
    sizes = named.groupBy("_c").agg(F.count("*").alias("memories")).where(F.col("memories") >= least)
    first = latest_of(named, "_c", ["memory_id"], examples).groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "content"))), lambda x: x["content"]).alias("examples"))
    return sizes.join(first, "_c").withColumnRenamed("_c", "category"), named.join(sizes.select("_c"), "_c", "left_anti").select(memories.columns)


def gather(memories: DataFrame, topic: str | None, most: int) -> DataFrame:
    """What reflection looks at: the latest memories of each user (user_id, seq, content), those of a topic first: (user_id, material), numbered lines."""
    hit = F.contains(F.lower("content"), F.lit(topic.lower())) if topic else F.lit(False)
    first = latest_of(memories.withColumn("hit", hit), "user_id", [F.desc("hit"), F.desc("seq")], most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "content"))), lambda x: F.concat(x["rn"].cast("string"), F.lit(". "), x["content"]))
    return first.groupBy("user_id").agg(F.array_join(lines, "\n").alias("material"))


def parse_insights(answers: DataFrame) -> DataFrame:
    """Insights in a model's answers (user_id, answer), a JSON array within other text: (user_id, place, content, confidence), confidence 0.5 if missing and clamped to 0..1. Unreadable answers give none."""
    inner = F.from_json(F.regexp_extract("answer", r"(?s)(\[.*\])", 1), "array<struct<content: string, confidence: double>>")
    rows = answers.select("user_id", F.posexplode(inner).alias("place", "x")).where(F.trim(F.coalesce("x.content", F.lit(""))) != "")
    return rows.select("user_id", "place", F.trim("x.content").alias("content"), F.least(F.greatest(F.coalesce("x.confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def refine(facts: DataFrame, latest: int = 20, least: int = 3, keys: int = 8) -> DataFrame:
    """Proposals to merge a category's latest active facts: (category, source_ids, summary): the category and its first distinct keys."""
    rows = latest_of(facts.where("archived = 0"), "category", [F.desc("recorded_s"), F.desc("id")], latest)
    grouped = rows.groupBy("category").agg(F.array_sort(F.collect_list("id")).alias("source_ids"), F.slice(F.array_sort(F.collect_set("fact_key")), 1, keys).alias("_k")).where(F.size("source_ids") >= least)
    return grouped.select("category", "source_ids", F.concat(F.col("category"), F.lit(": "), F.array_join("_k", ", ")).alias("summary"))


def apply_refinements(facts: DataFrame, proposals: DataFrame) -> DataFrame:
    """facts (id, category, fact_key, fact_value, archived) after proposals: their sources archived, and a fact refined:<first source> with each summary. Its id is the first source's, negated less one."""
    gone = proposals.select(F.explode("source_ids").alias("id")).distinct().withColumn("_g", F.lit(1))
    left = facts.join(gone, "id", "left").withColumn("archived", F.when(F.col("_g") == 1, 1).otherwise(F.col("archived"))).select("id", "category", "fact_key", "fact_value", "archived")
    first = F.get("source_ids", F.lit(0))
    added = proposals.select((-first - 1).alias("id"), "category", F.concat(F.lit("refined:"), first).alias("fact_key"), F.col("summary").alias("fact_value"), F.lit(0).alias("archived"))
    return left.unionByName(added)


def undo_refinements(facts: DataFrame, proposals: DataFrame) -> DataFrame:
    """facts as they were before apply_refinements of these proposals, whose sources were all active."""
    back = proposals.select(F.explode("source_ids").alias("id")).distinct().withColumn("_b", F.lit(1))
    kept = facts.join(proposals.select(F.concat(F.lit("refined:"), F.get("source_ids", F.lit(0))).alias("fact_key")), "fact_key", "left_anti").select("id", "category", "fact_key", "fact_value", "archived")
    return kept.join(back, "id", "left").withColumn("archived", F.when(F.col("_b") == 1, 0).otherwise(F.col("archived"))).drop("_b")
