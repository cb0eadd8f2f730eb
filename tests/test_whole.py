"""Queries that do the whole job, against plain loops."""

import collections

import numpy as np
from pyspark.sql import functions as F

from cairn import plans
from cairn.operators import recall


def test_vector_topk_of_many_queries_is_as_of_few(spark, monkeypatch):
    monkeypatch.setattr(recall, "QUERY_BLOCK", 40)
    monkeypatch.setattr(recall, "VECTOR_BLOCK", 50)
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.round(r.standard_normal((230, 5)), 1).astype(np.float32))]
    rows += [(300, None), (301, [0.0] * 5), (302, [1.0, 2.0]), (303, rows[7][1]), (304, rows[7][1]), (305, [None] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    blocks = {tuple(x) for x in recall.vector_topk(vectors, queries, 4).collect()}
    monkeypatch.setattr(recall, "FEW_QUERIES", 1_000)
    assert blocks == {tuple(x) for x in recall.vector_topk(vectors, queries, 4).collect()}


def test_vector_topk_makes_few_scores_one_by_one(spark, monkeypatch):
    """Blocks give the rows and scores of plain loops, odd vectors included, while only a few pairs of plain vectors are compared one by one."""
    import pyarrow as pa

    r, seen, real = np.random.default_rng(6), [], recall._cosines
    monkeypatch.setattr(recall, "_cosines", lambda q, v: seen.append(len(q) * len(v)) or real(q, v))
    vectors = [x.tolist() for x in r.standard_normal((300, 8)).astype(np.float32)]
    vectors[5:12] = [None, [0.0] * 8, [1e-160] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], [None] + [1.0] * 7]
    vectors[40], vectors[41] = vectors[39], [2 * x for x in vectors[39]]
    kind, ids = pa.list_(pa.float64()), np.arange(300)
    table = lambda i, v: pa.table({i: pa.array(ids), v: pa.array(vectors, kind)})
    found = recall._topk(table("qid", "qvec"), table("vec_id", "embedding"), 6).to_pylist()
    assert sum(seen) < 0.1 * 300 * 300
    exact = real(vectors, vectors)
    want = []
    for i in range(300):
        key = [(-(np.inf if np.isnan(s) else s), j) for j, s in enumerate(exact[i]) if j != i]
        want += [(i, j, exact[i, j]) for _, j in sorted(key)[:6]]
    assert [(x["qid"], x["vec_id"], "null" if x["score"] is None else str(x["score"])) for x in found] == [(i, j, "null" if np.isneginf(s) else str(float(s))) for i, j, s in want]


def test_vector_topk_takes_more_than_ten_thousand_queries(spark):
    vectors = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(20)], "vec_id long, embedding array<double>")
    queries = spark.range(100, 10_600).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.lit(0.71)).alias("qvec"))
    assert recall.vector_topk(vectors, queries, 1).groupBy("vec_id").count().collect() == [(7, 10_500)]


def test_spread_goes_three_hops_from_every_seed(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([x.vec_id for x in rows]), np.array([x.embedding for x in rows], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    cos = m @ m.T
    np.fill_diagonal(cos, -2)
    best = {i: [int(ids[j]) for j in np.lexsort((ids, -cos[k]))[:6] if 0.2 <= cos[k, j] <= 0.9][:3] for k, i in enumerate(ids.tolist())}
    want = set()
    for seed in ids[ids % 50 == 0].tolist():
        seen, front = {seed}, [seed]
        want.add((seed, seed, 0))
        for hop in (1, 2, 3):
            front = sorted({d for s in front for d in best[s]} - seen)
            seen |= set(front)
            want |= {(seed, n, hop) for n in front}
    assert {(x.seed, x.node, x.depth) for x in plans.QUERIES["d23_spread"](spark, folder).collect()} == want
    assert collections.Counter(d for *_, d in want)[3] > 0


def test_coalesce_is_the_plain_fold_of_its_own_rows(spark, folder):
    from test_operators import loop

    rows = [(str(r.user_id), r.ts.timestamp(), len(r.props), r.event_id) for r in spark.read.parquet(f"{folder}/events.parquet").collect()]
    got = sorted(map(tuple, plans.QUERIES["j2_coalesce"](spark, folder).collect()))
    want = loop([(k, round(t, 6), n, i) for k, t, n, i in rows], "default")
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[3:] == b[3:] and abs(a[1] - b[1]) < 1e-3 and abs(a[2] - b[2]) < 1e-3


def test_coalesce_of_busy_keys(spark):
    from test_operators import loop

    from cairn.streaming import coalesce

    r = np.random.default_rng(3)
    rows = [(f"k{int(k)}", float(t), int(n), i) for i, (k, t, n) in enumerate(zip(r.integers(0, 3, 3000), np.round(r.uniform(1e6, 1e6 + 9000, 3000), 1), r.integers(1, 900, 3000)))]
    for profile in coalesce.PROFILES:
        got = coalesce.coalesce_batch(spark.createDataFrame(rows, "key string, ts_s double, size int, seq long"), profile).collect()
        assert sorted(map(tuple, got)) == loop(rows, profile)


def test_feedback_is_the_plain_fold_of_its_own_rows(spark, folder):
    import math

    events = spark.read.parquet(f"{folder}/events.parquet").collect()
    count = collections.Counter(f"u{e.user_id}:{e.event_type}" for e in events)
    now = {k: min(1.0, n / 20) for k, n in count.items()}
    for e in sorted(events, key=lambda e: e.event_id):
        hits, key = math.floor(e.value) % 5, f"u{e.user_id}:{e.event_type}"
        now[key] = min(1.0, max(0.05, now[key] + (0.15 if hits >= 3 else -0.12 if hits == 0 else 0.05)))
    got = {r.memory_id: r.adjusted for r in plans.QUERIES["g5_feedback"](spark, folder).collect()}
    assert got.keys() == now.keys() and all(abs(got[k] - now[k]) < 2e-6 for k in now)


def test_all_jobs_are_given_not_the_latest_200(spark, tmp_path):
    spark.range(900).selectExpr("id AS event_id", "timestamp_seconds(1000 + id div 3) AS ts", "id % 300 AS user_id", "'click' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.event_id, r.updates) for r in plans.QUERIES["j5_latest_jobs"](spark, str(tmp_path)).collect()}
    assert got == {k: (600 + k, 3) for k in range(300)}
