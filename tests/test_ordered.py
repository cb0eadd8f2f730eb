"""State carried from row to row against plain loops over sorted rows, with keys that hold half of all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import rules
from cairn.operators import lifecycle, ordered, writes


def plain_writes(rows, ttl):
    since, out = {}, set()
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in since or at - since[key] > ttl:
            since[key] = at
            out.add(i)
    return out


def test_entries_live_from_their_writing(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 2400.0), ("a", 3, 4800.0)], "k string, id long, at double")
    assert {r.id for r in ordered.cache_writes(rows, ["k"], 3600).collect()} == {1, 3}


@pytest.mark.parametrize("ttl", [1, 7, 90])
def test_cache_writes(spark, ttl):
    r = random.Random(ttl)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), k, r.randrange(900)) for k in range(700)] + [("c", 1000 + k, k) for k in range(300)] + [("d", 2000 + k, 5) for k in range(40)]
    frame = spark.createDataFrame(rows, "k string, id long, at long").withColumn("next", F.lit(1))
    assert {x.id for x in ordered.cache_writes(frame, ["k"], ttl).collect()} == plain_writes(rows, ttl)
    assert ordered.cache_writes(frame.limit(0), ["k"], ttl).count() == 0


def test_no_task_of_cache_writes_holds_a_busy_key(spark):
    """The windows are by key and slot of time."""
    rows = spark.range(4000).select(F.lit("hot").alias("k"), "id", F.col("id").cast("double").alias("at"))
    found = ordered.first_after(rows.select("k", F.col("id").alias("pid"), (F.col("at") + 10).alias("at"), F.lit(ordered.LAST).alias("tie")), rows, ["k"], 10.0)
    plan = found._jdf.queryExecution().toString()
    assert all("_slot" in w for w in re.findall(r"windowspecdefinition\(([^)]*?)ASC|windowspecdefinition\(([^)]*?)DESC", plan) for w in w if w)
    assert {x.pid: x.next and x.next.id for x in found.collect()} == {k: k + 11 if k + 11 < 4000 else None for k in range(4000)}


def test_reached_doubles_its_steps(spark, monkeypatch):
    made = []
    real = ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df, label, *a: made.append(label) or real(df, label, *a))
    nodes = [(k, k + 1 if k < 499 else None, k == 100) for k in range(500)] + [(900, 901, False), (901, None, False)]
    got = {r.id for r in ordered.reached(spark.createDataFrame(nodes, "id long, next long, start boolean")).collect()}
    assert got == set(range(100, 500)) and len(made) <= 2 + 9


def plain_gate(spark, rows):
    judged = {r.id: (r.g.reason, r.g.scope) for r in spark.createDataFrame(rows, "user_id string, id long, at long, query string").select("id", rules.relevance(F.col("query")).alias("g")).collect()}
    state, out = {}, {}
    for user, i, at, q in sorted(rows, key=lambda r: (r[2], r[1])):
        reason, scope = judged[i]
        since, on = state.get(user, (None, False))
        if reason not in ("query_too_short", "social_closer"):
            if reason != "correction_detected" and on and at - since < 15 and len(q.strip()) < 12:
                reason, scope = "session_followup_hot", "episode"
            else:
                state[user] = (at, scope is not None)
        out[i] = (reason, scope, scope is not None)
    return out


def test_gate_decisions(spark):
    r = random.Random(4)
    said = ["why?", "and then", "ok", "no", "remember it", "do you recall what we said", "wrong!", "wrong, it is another one", "a plain sentence of words", "thanks!", "how to fix the error here", "继续", "hm", "x y z", "my user"]
    rows = [(r.choice(["hot", "hot", "hot", "a", "b"]), k, r.randrange(2500), r.choice(said)) for k in range(900)]
    got = {x.id: (x.reason, x.scope, x.needs_memory) for x in ordered.gate_decisions(spark.createDataFrame(rows, "user_id string, id long, at long, query string")).collect()}
    want = plain_gate(spark, rows)
    assert got == want
    assert {x[0] for x in want.values()} >= {"session_followup_hot", "correction_detected", "social_closer", "explicit_recall", "no_signal", "content_query"}


def test_a_carried_decision_is_not_renewed(spark):
    rows = [("u", 1, 0, "remember the plan"), ("u", 2, 10, "hm why"), ("u", 3, 14, "and so"), ("u", 4, 16, "and so"), ("u", 5, 17, "go on"), ("u", 6, 20, "x y z")]
    got = {x.id: x.reason for x in ordered.gate_decisions(spark.createDataFrame(rows, "user_id string, id long, at long, query string")).collect()}
    assert got == {1: "explicit_recall", 2: "session_followup_hot", 3: "session_followup_hot", 4: "no_signal", 5: "reference", 6: "session_followup_hot"}


def test_feedback_of_busy_memories(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 4)
    r = random.Random(9)
    signals = [(r.choice(["hot", "hot", "hot", "a", "b"]), k, r.choice(["useful", "useless", "correction", "other"])) for k in range(-50, 700)]
    now = {"hot": 0.5, "a": 1.0, "b": 0.05, "none": 0.33}
    want = dict(now)
    step = {"useful": 0.15, "useless": -0.12, "correction": 0.05, "other": 0.0}
    for key, _, s in sorted(signals, key=lambda x: x[1]):
        want[key] = min(1.0, max(0.05, want[key] + step[s]))
    frame = spark.createDataFrame(list(now.items()), "memory_id string, salience double")
    got = lifecycle.feedback(frame, spark.createDataFrame(signals, "memory_id string, seq long, signal string"))
    assert all(abs(x.adjusted - want[x.memory_id]) < 1e-9 for x in got.collect())
    none = lifecycle.feedback(frame, spark.createDataFrame([], "memory_id string, seq long, signal string"))
    assert {x.memory_id: x.adjusted for x in none.collect()} == now


def test_fast_add_does_not_renew_an_entry(spark):
    rows = spark.createDataFrame([(k, "k", 40.0 * k, "some text") for k in range(4)], "seq long, key string, ts_s double, content string")
    got = {x.seq: x.way for x in writes.fast_add(rows, spark.createDataFrame([], "key string, content_hash string"), 60).collect()}
    assert got == {0: "extract", 1: "cached", 2: "extract", 3: "cached"}
