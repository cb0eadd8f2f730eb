"""Recall: search, scores, ladders and budgets."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources.shared import stored
from . import postings

#: So many queries are broadcast; more are compared in blocks of these many queries and vectors (on average).
FEW_QUERIES, QUERY_BLOCK, VECTOR_BLOCK = 100, 4_096, 8_192
#: Queries of a block that are compared at once.
QUERY_PART = 512


def keyword_search(rows: DataFrame, terms: list[str], column: str, limit: int, order: list) -> DataFrame:
    """Rows whose lower text holds any of the terms, the first by the order, which should be total."""
    low = F.lower(F.col(column))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t.lower()))
    return rows.where(hit).orderBy(*order).limit(limit)


def like_search(rows: DataFrame, terms: list[str], user: str | None, limit: int, order: list, column: str = "content") -> DataFrame:
    """A user's rows that hold any of the terms, without regard to case; all of them without terms. The first by the order."""
    mine = rows if user is None else rows.where(F.col("user_id") == user)
    return keyword_search(mine, terms, column, limit, order) if terms else mine.orderBy(*order).limit(limit)


def bm25(rows: DataFrame, query: str, id_col: str, text_col: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 of one query over an index of rows, made for it: (id, score), best first, then by id. Many queries share an index by postings.bm25_many."""
    asked = rows.sparkSession.createDataFrame([(0, query)], "qid int, query string")
    return postings.bm25_many(postings.build(rows, id_col, text_col), asked, limit, k1, b).select("id", "score").orderBy(F.desc(F.round("score", 9)), "id")


def structured(facts: DataFrame, needle: str, as_of: int, limit: int, least_trust: float = 0.2, category: str | None = None) -> DataFrame:
    """Trusted facts that hold the needle anywhere: valid ones first, then exact keys, exact categories, the rest; by trust and recency."""
    low, n = needle.lower(), F.lit(needle.lower())
    if low:
        facts = facts.where(F.contains(F.lower("category"), n) | F.contains(F.lower("fact_key"), n) | F.contains(F.lower("fact_value"), n))
    if category is not None:
        facts = facts.where(F.col("category") == category)
    stale = F.coalesce((F.col("valid_to_s") < as_of) | (F.col("valid_from_s") > as_of), F.lit(False))
    exact = F.when(F.col("fact_key") == needle, 0).when(F.col("category") == needle, 1).otherwise(2)
    kept = facts.where(F.col("trust_score") >= max(0.2, least_trust)).withColumn("stale", F.when(stale, 2).otherwise(0)).withColumn("exact", exact)
    return kept.orderBy("stale", "exact", F.desc("trust_score"), F.desc("recorded_s"), "id").limit(max(1, min(100, limit)))


def by_tier(facts: DataFrame, as_of: int) -> DataFrame:
    """facts with fed_score: weight of the tier, decay since it was recorded, and trust."""
    return facts.withColumn("fed_score", scores.tier_score(F.col("memory_tier"), as_of - F.col("recorded_s"), F.col("trust_score")))


def ladder(facts: DataFrame, agent: str, profile: str, as_of: int, k: int, default_agent: str = "local") -> DataFrame:
    """An agent's own facts; if these are fewer than 0.6 k, shared facts of its profile too; if still fewer, all shared facts. Best k by fed_score.

    Each fact stands on its first rung. How many stand on each rung is one row of three counts.
    """
    who = F.coalesce("agent_id", F.lit(default_agent))
    shared = F.coalesce("shared", F.lit(1)) == 1
    rung = F.when(who == agent, 1).when(shared & (F.col("profile") == profile), 2).when(shared, 3)
    placed = by_tier(facts.where("archived = 0"), as_of).withColumn("rung", rung).where("rung IS NOT NULL")
    counts = {r["rung"]: r["count"] for r in placed.groupBy("rung").count().collect()}
    enough = max(1, int(0.6 * k))
    last = 1 if counts.get(1, 0) >= enough else 2 if counts.get(1, 0) + counts.get(2, 0) >= enough else 3
    return placed.where(F.col("rung") <= last).orderBy(F.desc("fed_score"), "id").limit(k)


def rerank(rows: DataFrame, query: str, score: str, first: int, text_col: str, id_col: str = "id") -> DataFrame:
    """The first rows by score get 0.6 of their Jaccard with the query and 0.4 of the score; the others keep theirs. rows is a short list."""
    place = F.row_number().over(Window.orderBy(F.desc(score), id_col))
    alike = text.gram_word_jaccard(text.gram_sets(F.col(text_col)), text.gram_sets(F.lit(query)))
    return rows.withColumn("place", place).withColumn("reranked", F.when(F.col("place") <= first, 0.6 * alike + 0.4 * F.col(score)).otherwise(F.col(score)))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays in double precision; null if either is zero."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(length > 0, product(a, b) / length)


def _lengths(rows: list) -> dict[int, list[int]]:
    """The places of the vectors of each length; those that are null or hold a null are under -1."""
    found: dict[int, list[int]] = {}
    for k, v in enumerate(rows):
        found.setdefault(-1 if v is None or None in v else len(v), []).append(k)
    return found


def _cosines(queries: list, vectors: list) -> np.ndarray:
    """cosine() of each query and vector, summed in its order; -inf where that is null."""
    out = np.full((len(queries), len(vectors)), -np.inf)
    of_length = _lengths(vectors)
    for n, qs in _lengths(queries).items():
        if n < 1 or n not in of_length:
            continue
        vs = of_length[n]
        q, v = np.array([queries[k] for k in qs], np.float64).T, np.array([vectors[k] for k in vs], np.float64).T
        product, qq, vv = np.zeros((len(qs), len(vs))), np.zeros(len(qs)), np.zeros(len(vs))
        with np.errstate(all="ignore"):
            for x, y in zip(q, v):
                product += x[:, None] * y[None, :]
                qq += x * x
                vv += y * y
            length = np.sqrt(qq)[:, None] * np.sqrt(vv)[None, :]
            out[np.ix_(qs, vs)] = np.where(length == 0, -np.inf, product / length)
    return out


def _plain(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have no null, the commonest length and lengths in space far from the ends of what numbers can tell, and a matrix of these."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    some = sizes[sizes > 0]
    n = int(np.bincount(some).argmax()) if len(some) else 0
    ok = sizes == n if n else np.zeros(len(sizes), bool)
    values = lists.filter(pa.array(ok)).flatten()
    rows = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n or 1)  # nulls are NaN
    with np.errstate(all="ignore"):
        size = np.sqrt((rows * rows).sum(axis=1))
        fits = (size > 1e-100) & (size < 1e100)
    ok[np.flatnonzero(ok)[~fits]] = False
    return ok, rows[fits]


def _topk(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(qid, vec_id, score): for each query of left its k best rows of right, which is in the order of vec_id, itself excluded; equal ones by vec_id.

    A product of matrices in single precision tells which rows may be among the best, within its error; only their scores are made as cosine() makes them. Vectors
    of another length, with nulls, without direction or of extreme length are compared one by one with all.
    """
    qid, vid = left.column("qid").to_numpy(), right.column("vec_id").to_numpy()
    (plain_q, q), (plain_v, v) = _plain(left.column("qvec")), _plain(right.column("embedding"))
    if q.shape[1] != v.shape[1]:
        plain_q, q = np.zeros(len(qid), bool), np.zeros((0, v.shape[1]))
    rank = np.full((len(qid), len(vid)), -np.inf)
    unit = lambda m: (m / np.sqrt((m * m).sum(axis=1))[:, None]).astype(np.float32)
    if plain_q.all() and plain_v.all():
        rank = unit(q) @ unit(v).T
    else:
        rank[np.ix_(plain_q, plain_v)] = unit(q) @ unit(v).T
        listed = lambda t, c, rows: t.column(c).take(pa.array(rows)).to_pylist()
        every, odd_q, odd_v = np.arange(len(vid)), np.flatnonzero(~plain_q), np.flatnonzero(~plain_v)
        rank[np.ix_(odd_q, every)] = _cosines(listed(left, "qvec", odd_q), listed(right, "embedding", every))
        rank[np.ix_(np.flatnonzero(plain_q), odd_v)] = _cosines(listed(left, "qvec", np.flatnonzero(plain_q)), listed(right, "embedding", odd_v))
        rank[np.isnan(rank)] = np.inf  # as Spark orders NaN
    own = vid[None, :] == qid[:, None]
    rank[own] = -np.inf
    error = (v.shape[1] + 8) * 2.0**-21
    least = np.partition(rank, len(vid) - k, axis=1)[:, len(vid) - k] - error if len(vid) > k else np.full(len(qid), -np.inf)
    at, to = np.nonzero((rank >= least[:, None]) & ~own)
    score = rank[at, to].astype(np.float64)
    exact = plain_q[at] & plain_v[to]
    i, j = (np.cumsum(plain_q) - 1)[at[exact]], (np.cumsum(plain_v) - 1)[to[exact]]
    product, qq, vv = np.zeros(len(i)), np.zeros(len(q)), np.zeros(len(v))
    for x, y in zip(q.T, v.T):  # summed in the order of cosine()
        product += x[i] * y[j]
        qq += x * x
        vv += y * y
    score[exact] = product / (np.sqrt(qq)[i] * np.sqrt(vv)[j])
    order = np.lexsort((to, -score, at))
    at, to, score = at[order], to[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    at, to, score = at[keep], to[keep], score[keep]
    score = np.where(np.isposinf(score), np.nan, score)
    return pa.table({"qid": pa.array(qid[at]), "vec_id": pa.array(vid[to]), "score": pa.array(score, mask=np.isneginf(score))})


def _topk_of_blocks(vectors: DataFrame, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(qid, vec_id, score): of each block of queries with each block of vectors the k best rows of each query."""
    n_q, n_v = -(-n_queries // QUERY_BLOCK), -(-vectors.count() // VECTOR_BLOCK) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("qid", "qvec", block("qid", n_q).alias("_q")).withColumn("_v", every(n_v))
    v = vectors.select("vec_id", "embedding", block("vec_id", n_v).alias("_v")).withColumn("_q", every(n_q))
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.array(np.argsort(right.column("vec_id").to_numpy(), kind="stable")))
        parts = [_topk(left.slice(at, QUERY_PART), right, k) for at in range(0, left.num_rows if right.num_rows else 0, QUERY_PART)]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInArrow(best, "qid long, vec_id long, score double")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query (qid, qvec) its k nearest rows (vec_id, embedding) by cosine, itself excluded: (qid, vec_id, score, rn).

    Ids are longs. A few queries are broadcast after a check of their number, and each task ranks its own rows before the rest is ranked;
    more are cut into hashed blocks, of which each meets each block of rows in a task of its own that gives k rows a query.
    """
    n = queries.count()
    if n <= FEW_QUERIES:
        scored = vectors.join(F.broadcast(queries), F.col("vec_id") != F.col("qid")).select("qid", "vec_id", cosine(F.col("embedding"), F.col("qvec")).alias("score"))
    else:
        scored = _topk_of_blocks(vectors, queries, n, k)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rn", rank).where(F.col("rn") <= k)


def ignite(rows: DataFrame, query: str, text_col: str, vector: str, least: float, most: int, id_col: str = "id") -> DataFrame:
    """combined = 0.6 Jaccard + 0.4 vector score; the first `most` rows that reach `least` are ignited. rows is a short list."""
    alike = text.gram_word_jaccard(text.gram_sets(F.col(text_col)), text.gram_sets(F.lit(query)))
    scored = rows.withColumn("combined", 0.6 * alike + 0.4 * F.least(F.greatest(F.col(vector), F.lit(0.0)), F.lit(1.0)))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("combined", 9)), id_col))
    return scored.withColumn("place", place).withColumn("ignited", (F.col("place") <= most) & (F.col("combined") >= least))


#: How much an ignited row's score counts for, and how many times the limit the first pool is.
BOOST, POOL = 1.5, 3


def boost_sort(rows: DataFrame, score: str, limit: int, id_col: str = "id") -> DataFrame:
    """Rows of ignite() in their last order: ignited ones by combined score, then the others by their own. rows is a short list."""
    own = F.when(F.col("ignited"), F.col("combined") * BOOST).otherwise(F.col(score))
    return rows.withColumn("boosted", own).orderBy(F.desc("ignited"), F.desc(F.round("boosted", 9)), id_col).limit(limit)


def hybrid_search(rows: DataFrame, query: str, as_of: int, limit: int, after_s: int | None = None, before_s: int | None = None) -> DataFrame:
    """Rows (id, content, score, at_s, reliability, access) of a span of time by the five signals: (id, hybrid), best first. The text signal is the query's coverage."""
    if after_s is not None:
        rows = rows.where(F.col("at_s") >= after_s)
    if before_s is not None:
        rows = rows.where(F.col("at_s") <= before_s)
    age = F.greatest(F.lit(as_of) - F.col("at_s"), F.lit(0)) / scores.DAY
    covered = text.query_coverage(F.lit(query), F.col("content"))
    hybrid = scores.recall_score(scores.squash(F.col("score")), covered, age, F.col("reliability"), F.col("access"))
    return rows.withColumn("hybrid", F.round(hybrid, 4)).orderBy(F.desc("hybrid"), "id").limit(limit)


def funnel(rows: DataFrame, query: str, states: DataFrame, as_of: int, limit: int, least: float = 0.85, most: int = 8) -> DataFrame:
    """The recall funnel over rows (id, content, score, at_s, reliability, access): (id, ignited, hybrid, place).

    The best POOL * limit rows by score are the pool. Alike ones are ignited; of rows with the same first 100 characters the ignited or else the first stays; rows that states (memory_id,
    state) call superseded go. The five signals rank twice the limit of them, an ignited row by the better of its scores; then ignition counts BOOST times, and the limit is cut. The pool
    bounds what the windows see.
    """
    pool = rows.orderBy(F.desc("score"), "id").limit(POOL * limit)
    lit = ignite(pool.withColumn("vector", scores.squash(F.col("score"))), query, "content", "vector", least, most)
    once = first_of_each(lit.withColumn("head", F.substring("content", 1, 100)), ["head"], [F.desc("ignited"), F.when(F.col("ignited"), F.col("place")), F.desc("score"), "id"])
    gone = states.where("state = 'superseded'").select(F.col("memory_id").alias("id")).distinct()
    live = once.join(gone, "id", "left_anti").withColumn("score", F.when(F.col("ignited"), F.greatest("score", "combined")).otherwise(F.col("score")))
    ranked = hybrid_search(live, query, as_of, 2 * limit)
    last = ranked.withColumn("hybrid", F.when(F.col("ignited"), F.round(F.col("hybrid") * BOOST, 4)).otherwise(F.col("hybrid")))
    place = F.row_number().over(Window.orderBy(F.desc("hybrid"), "id"))
    return last.withColumn("place", place).where(F.col("place") <= limit).select("id", "ignited", "hybrid", "place")


def funnel_counts(rows: DataFrame, query: str, states: DataFrame, as_of: int, limit: int, least: float = 0.85, most: int = 8) -> DataFrame:
    """How many rows the stages of the funnel have: (pool, ignited, final, from_ignition), one row."""
    pool = rows.orderBy(F.desc("score"), "id").limit(POOL * limit)
    lit = ignite(pool.withColumn("vector", scores.squash(F.col("score"))), query, "content", "vector", least, most)
    first = lit.agg(F.count("*").alias("pool"), F.count_if("ignited").alias("ignited")).withColumn("k", F.lit(1))
    last = funnel(rows, query, states, as_of, limit, least, most).agg(F.count("*").alias("final"), F.count_if("ignited").alias("from_ignition")).withColumn("k", F.lit(1))
    return first.join(last, "k").drop("k")


def workspace_lookup(items: DataFrame, queries: DataFrame, least: float = 0.5) -> DataFrame:
    """Items of each user's working set (user_id, memory_id, text, score) that a query (query_id, user_id, query) hits: (query_id, memory_id, combined), 0.7 of the words' Jaccard and 0.3 of the score over `least`."""
    joined = queries.join(items, "user_id")
    alike = text.jaccard(text.words(F.col("query")), text.words(F.col("text")))
    combined = 0.7 * alike + 0.3 * F.coalesce("score", alike)
    return joined.select("query_id", "memory_id", combined.alias("combined")).where((F.col("combined") > least) & (F.col("memory_id").isNotNull()))


def expand(vectors: DataFrame, nodes: DataFrame, k: int, least: float = 0.2, most: float = 0.9) -> DataFrame:
    """The neighbours of each node (node), itself excluded: (node, vec_id, score), those of its k nearest with a score within bounds."""
    queries = vectors.join(nodes.select(F.col("node").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return vector_topk(vectors, queries, k).where(F.col("score").between(least, most)).select(F.col("qid").alias("node"), "vec_id", "score")


#: Fixed weights of the levels of persona memory.
LEVELS = {"E": 1.0, "G": 0.75, "L": 0.5}


def persona_retrieve(items: DataFrame, query: str, k: int, level: str | None = None) -> DataFrame:
    """Of each bank's latest ready version (bank, version, ready, level, item_id, content) the k best items for a query, 50 at most: (bank, item_id, score). Items without a hit are left out."""
    latest = items.where("ready").groupBy("bank").agg(F.max("version").alias("version"))
    live = items.where("ready").join(latest, ["bank", "version"])
    if level is not None:
        live = live.where(F.col("level") == level)
    weighed = live.withColumn("score", text.persona_score(F.lit(query), F.col("content")) * scores.choose(F.col("level"), LEVELS, 0.0)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("bank").orderBy(F.desc(F.round("score", 9)), "item_id"))
    return weighed.withColumn("_rn", rank).where(F.col("_rn") <= min(50, k)).select("bank", "item_id", "score")


def within_budget(rows: DataFrame, line: str | Column, order: list, budget: int, partition: list[str]) -> DataFrame:
    """Rows in order until the first whose line, with a newline, would overflow the budget of its partition; budget 0 or less: all. line names a column of lines, or is a column of their lengths."""
    if budget <= 0:
        return rows
    sized = rows.withColumn("_n", ((F.length(line) if isinstance(line, str) else line) + 1).cast("long"))
    # Slots are ranges of the order, so that a partition of any size is many tasks; those that begin beyond the budget are not ordered at all.
    ranged = stored(sized.repartitionByRange(*partition, *order).withColumn("_slot", F.spark_partition_id()), "budget")
    slots = ranged.groupBy(*partition, "_slot").agg(F.sum("_n").alias("_sum"))
    slots = slots.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*partition).orderBy("_slot")) - F.col("_sum")).where(F.col("_before") < budget)
    slots = slots.select(*[F.col(c).alias(f"_p{k}") for k, c in enumerate(partition)], F.col("_slot").alias("_s"), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_p{k}")) for k, c in enumerate(partition)]
    inside = Window.partitionBy(*partition, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = ranged.join(slots, reduce(and_, same, F.col("_slot") == F.col("_s"))).withColumn("used", F.sum("_n").over(inside) + F.col("_before"))
    return opened.where(F.col("used") <= budget).select(*rows.columns, "used")


def earlier_context(turns: DataFrame, before: int = 5, most: int = 200) -> DataFrame:
    """turns with context: the last few turns' texts of the session, cut, oldest first."""
    window = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-before, -1)
    return turns.withColumn("context", F.array_join(F.collect_list(F.substring("content", 1, most)).over(window), " | "))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by the order; rows with a null key all stay.

    A row with a null key is a key of its own, so that these rows are not one task's. The filter is on the rank alone, so that each task keeps its own first row of a key before the shuffle.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rank = F.row_number().over(Window.partitionBy(*keys, "_own").orderBy(*order))
    return rows.withColumn("_own", F.when(~known, F.monotonically_increasing_id())).withColumn("_rn", rank).where("_rn = 1").drop("_own", "_rn")


#: Fixed values of deep search: how many keyword hits, entity hits and results, and how many terms.
DEEP_WORDS, DEEP_ENTITIES, DEEP_RESULTS, DEEP_TERMS = 20, 10, 15, 12


def deep_search(facts: DataFrame, edges: DataFrame, entities: DataFrame, terms: list[str], names: list[str]) -> DataFrame:
    """Active facts (id, fact_value, trust_score, preference, archived) that hold any of the first terms, by trust times one and the preference, and those of edges (fact_id, entity_id) to entities (entity_id, name) of these
    names, by trust: (id, place, by), each fact once, where it comes first. Equal ones by id.
    """
    active = facts.where("archived = 0")
    weight = F.col("trust_score") * (1 + F.coalesce("preference", F.lit(0.0)))
    words = keyword_search(active.select("id", "fact_value", weight.alias("w")), terms[:DEEP_TERMS], "fact_value", DEEP_WORDS, [F.desc("w"), "id"]).select("id", "w", F.lit("word").alias("by"))
    linked = edges.join(entities.where(F.col("name").isin(names)).select("entity_id"), "entity_id").select(F.col("fact_id").alias("id")).distinct()
    named = active.join(linked, "id").select("id", F.col("trust_score").alias("w"), F.lit("entity").alias("by")).orderBy(F.desc("w"), "id").limit(DEEP_ENTITIES)
    once = first_of_each(words.unionByName(named), ["id"], [F.desc("by")])
    place = F.row_number().over(Window.orderBy(F.desc("by"), F.desc("w"), "id"))  # at most DEEP_WORDS + DEEP_ENTITIES rows
    return once.withColumn("place", place).where(F.col("place") <= DEEP_RESULTS).select("id", "place", "by")


#: Fixed values of fusion: the least quota of hits, the share of the limit that it is, and the terms that a hit shares with its query.
QUOTA, QUOTA_SHARE, OVERLAP = 2, 4, 2


def fuse_verbatim(main: DataFrame, hits: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The results of each query with its verbatim hits: (qid, id, place, verbatim, has_verbatim).

    main and hits are (qid, place, id, content), queries (qid, query). A hit equal to a result, but for white space and case, only marks the first such result. Of the others, those that share OVERLAP
    terms with the query (all of them, if it has fewer terms) are taken, each text once, up to a quota; they stand at the end, and results at the end make room for them within the limit.
    """
    norm = F.lower(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", "")).alias("norm")
    m, h = main.select("qid", "id", "place", norm), hits.select("qid", "id", "place", "content", norm)
    wanted = h.where("norm <> ''").select("qid", "norm").distinct().withColumn("hit", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("qid", "norm").orderBy("place", "id"))
    m = m.join(wanted, ["qid", "norm"], "left").withColumn("has_verbatim", F.coalesce("hit", F.lit(False)) & (nth == 1))
    asked = queries.select("qid", text.gate_terms(F.col("query")).alias("terms"))
    shared = F.size(F.array_intersect("terms", text.gate_terms(F.coalesce("content", F.lit("")))))
    fresh = h.join(m.select("qid", "norm").distinct().where("norm <> ''"), ["qid", "norm"], "left_anti").join(asked, "qid")
    fresh = fresh.where((F.size("terms") < OVERLAP) | (shared >= OVERLAP)).withColumn("_n", nth).where((F.col("_n") == 1) | (F.col("norm") == ""))
    in_order = F.row_number().over(Window.partitionBy("qid").orderBy("place", "id"))
    fresh = fresh.withColumn("k", in_order).where(F.col("k") <= max(QUOTA, limit // QUOTA_SHARE))
    counts = fresh.groupBy("qid").agg(F.count("*").alias("n"))
    kept = m.withColumn("k", in_order).join(counts, "qid", "left").where(F.col("n").isNull() | (F.col("k") <= F.greatest(F.lit(0), limit - F.col("n"))))
    before = kept.groupBy("qid").agg(F.count("*").alias("b"))
    added = fresh.join(before, "qid", "left").select("qid", "id", (F.coalesce("b", F.lit(0)) + F.col("k")).alias("place"), F.lit(True).alias("verbatim"), F.lit(False).alias("has_verbatim"))
    return kept.select("qid", "id", F.col("k").cast("long").alias("place"), F.lit(False).alias("verbatim"), "has_verbatim").unionByName(added)


def history_of(events: DataFrame, targets: DataFrame, limit: int = 100) -> DataFrame:
    """The first ledger events (event_id, target_id, ...) of each target (target) by event_id, under any of its names: itself, without and with 'fact:'. (target, event columns)."""
    t = F.trim("target")
    bare = F.when(F.startswith(t, F.lit("fact:")), F.substring(t, 6, 1 << 30)).otherwise(t)
    names = targets.where(t != "").select("target", F.explode(F.array_distinct(F.array(t, bare, F.concat(F.lit("fact:"), bare)))).alias("target_id")).where("target_id <> ''")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("event_id"))
    return events.join(names, "target_id").withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def annotate_kinds(rows: DataFrame, kinds: DataFrame, default: str = "FACTS") -> DataFrame:
    """rows (key, fact_id, ...) with kind, from kinds (ref, kind): by fact:<fact_id> where a row has one, else or failing that by its own key. refs are unique."""
    own, fact = F.col("key").cast("string"), F.concat(F.lit("fact:"), F.col("fact_id").cast("string"))
    first = kinds.select(F.col("ref").alias("_ref"), F.col("kind").alias("_first"))
    other = kinds.select(F.col("ref").alias("_alt"), F.col("kind").alias("_other"))
    joined = rows.withColumns({"_r": F.coalesce(fact, own), "_a": F.when(F.col("fact_id").isNotNull(), own)})
    joined = joined.join(first, F.col("_r") == F.col("_ref"), "left").join(other, F.col("_a") == F.col("_alt"), "left")
    return joined.select(*rows.columns, F.coalesce("_first", "_other", F.lit(default)).alias("kind"))
