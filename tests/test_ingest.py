"""Incremental reads, idempotent writes, and budgets over groups of any size."""

import random

from pyspark.sql import functions as F

from cairn.operators import recall
from cairn.streaming import coalesce, ingest

SCHEMA = "user_id string, session_id long, turn long, role string, ts_s long, content string"


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    at, store = str(tmp_path / "in"), str(tmp_path / "store")
    row = lambda k, content, role="user": ("u", k % 2, k, role, 100 + k, content)
    first, second = [row(1, "a first message"), row(2, "a second message"), row(3, "too short"), row(4, "of the system itself", "system")], [row(5, "a first message"), row(6, "x" * 2500), row(8, "x" * 2000)]
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(SCHEMA).parquet(at)
        query = ingest.follow(stream, store, str(tmp_path / "cursor"))
        query.awaitTermination(60)
        query.stop()
    want = sorted((r.session_id, r.first_turn, r.occurrences, r.first_s, r.last_s) for r in ingest.held(spark, store).collect())
    assert want == [(0, 2, 1, 102, 102), (0, 6, 2, 106, 108), (1, 1, 2, 101, 105)]
    ingest.writer(store)(spark.createDataFrame(second, SCHEMA), 1)  # the last batch again, as after a failure before its commit
    assert sorted((r.session_id, r.first_turn, r.occurrences, r.first_s, r.last_s) for r in ingest.held(spark, store).collect()) == want
    query = ingest.follow(spark.readStream.schema(SCHEMA).parquet(at), store, str(tmp_path / "cursor"))
    query.awaitTermination(60)
    assert sorted((r.session_id, r.first_turn, r.occurrences, r.first_s, r.last_s) for r in ingest.held(spark, store).collect()) == want


def test_budgets_stop_at_the_first_row_that_overflows(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["hot", "hot", "hot", "b", None]), r.randrange(50), "x" * r.randrange(40)) for k in range(600)] + [(900, "c", 1, "x" * 500)]
    want = set()
    for key in ("hot", "b", None, "c"):
        used = 0
        for k, _, _, line in sorted((x for x in rows if x[1] == key), key=lambda x: (-x[2], x[0])):
            used += len(line) + 1
            if used > 400:
                break
            want.add((k, used))
    frame = spark.createDataFrame(rows, "id long, cat string, w int, line string")
    got = recall.within_budget(frame, "line", [F.desc("w"), "id"], 400, ["cat"])
    assert {(x.id, x.used) for x in got.collect()} == want
    assert recall.within_budget(frame, "line", ["id"], 0, ["cat"]).count() == 601 and recall.within_budget(frame.limit(0), "line", ["id"], 5, ["cat"]).count() == 0


def test_messages_of_a_run_are_dealt_out_after_the_join(spark):
    """Without an exchange of its own below the fold, a join that becomes a broadcast leaves a run in as many tasks as it has slots."""
    frame = spark.range(100).selectExpr("concat('k', id % 2) AS key", "9D * (id div 2) AS ts_s", "20L AS size", "id AS seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = coalesce.coalesce_batch(frame)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    fold = plan[plan.index("MapInArrow") :]
    assert "REPARTITION_BY_COL" in fold[: fold.index("LeftSemi")]
