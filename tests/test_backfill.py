"""Moves between tiers and the rule of what waits in a buffer, on small rows."""

from pyspark.sql import functions as F

from cairn.operators import lifecycle
from cairn.streaming import coalesce

DAY = 86_400
TIERS = {"procedural": ("step",), "episodic": ("was",)}


def test_tier_backfill(spark):
    rows = [(1, "c", "k", "the STEP was", "semantic", 100), (2, "c", "k", "it was", "odd", 100), (3, None, None, None, "episodic", 100), (4, "c", "k", "plain", None, 100), (5, "was", "k", "x", "episodic", 1), (6, "c", "k", "step", "procedural", None)]
    facts = spark.createDataFrame(rows, "id long, category string, fact_key string, fact_value string, memory_tier string, recorded_s long")
    got = {r.id: (r.old, r.new, r.decay_s) for r in lifecycle.tier_backfill(facts, TIERS).collect()}
    assert got == {1: ("semantic", "procedural", None), 2: ("semantic", "episodic", 100 + 30 * DAY), 3: ("episodic", "semantic", 100 + 180 * DAY)}
    assert lifecycle.tier_backfill(facts.limit(0), TIERS).count() == 0


def test_buffer_reason(spark):
    rows = [
        ("plain words", "default", True, False, False, "ok"), ("plain words", "default", False, False, False, "sync_path"), ("plain words", "default", None, None, None, "sync_path"),
        ("plain words", "default", True, True, False, "opt_out"), (None, "tech", True, None, None, "empty"), ("  ", "tech", True, False, False, "empty"),
        ("x" * 450, "tech", True, False, False, "too_long"), ("x" * 450, None, True, False, False, "ok"), ("x" * 801, "intimate", True, False, False, "too_long"),
        ("我叫 x", "default", True, False, False, "fastpath_candidate"), ("我叫 x", "default", True, False, True, "ok"), ("key = value?", "default", True, False, False, "ok"),
    ]
    frame = spark.createDataFrame(rows, "content string, profile string, is_async boolean, out boolean, plain boolean, want string")
    got = frame.select("want", coalesce.buffer_reason(*[F.col(c) for c in ("content", "profile", "is_async", "out", "plain")]).alias("reason"))
    assert got.where("NOT (want <=> reason)").collect() == []
