"""Fusion, compression, sections, links, histories and deletion against plain versions and the known examples of their rules."""

import random

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import lifecycle, recall


def fused(spark, main, hits, query, limit):
    rows = lambda xs: spark.createDataFrame([(1, k, i, c) for k, (i, c) in enumerate(xs)], "qid int, place int, id string, content string")
    queries = spark.createDataFrame([(1, query)], "qid int, query string")
    got = recall.fuse_verbatim(rows(main), rows(hits), queries, limit).orderBy("place").collect()
    return [(r.id, r.verbatim, r.has_verbatim) for r in got]


def test_fuse_verbatim(spark):
    assert fused(spark, [("a", "I like hot latte"), ("b", "i LIKE  hot latte")], [("v", "i like HOT latte ")], "", 10) == [("a", False, True), ("b", False, False)]
    got = fused(spark, [(f"m{k}", f"main {k}") for k in range(10)], [(f"v{k}", f"raw text {k}") for k in range(6)], "", 10)
    assert got == [(f"m{k}", False, False) for k in range(8)] + [("v0", True, False), ("v1", True, False)]
    got = fused(spark, [("m", "other")], [("v0", "今天喝了热拿铁和咖啡"), ("v1", "只有咖啡"), ("v2", "nothing")], "热拿铁 咖啡", 10)
    assert [g[0] for g in got] == ["m", "v0"]
    assert fused(spark, [(f"m{k}", f"x {k}") for k in range(5)], [("v", "no words shared")], "alpha beta", 3) == [(f"m{k}", False, False) for k in range(5)]
    assert [g[0] for g in fused(spark, [("m", "x")], [("v0", "same text"), ("v1", "Same  text"), ("v2", "more")], "", 0)] == ["v0", "v2"]


def plain_lines(log):
    kept = []
    for line in log.split("\n"):
        low = line.lower()
        if any(w in low for w in ("error", "fail", "traceback", "exception", "❌", "panic", "fatal")) or line.strip().startswith('File "'):
            kept.append(line)
        elif len(line.strip()) < 3 or (low in ("ok", "done", "success") and kept and kept[-1].strip().lower() == low):
            continue
        else:
            kept.append(line)
    return kept


def test_compressed_lines(spark):
    r = random.Random(1)
    parts = ["done", "Done", " done", "success", "SUCCESS", "ok", "ok ", "x", "", "an error", "it failed", '  File "a.py"', "plain line", "plain line", "❌", "panic!", "\tab"]
    logs = ["\n".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(200)] + ["", "done\ndone\nx\ndone", "\n".join(["done", "ok"] * 9)]
    got = spark.createDataFrame(list(enumerate(logs)), "k int, log string").select("k", text.compressed_lines(F.col("log")).alias("x")).collect()
    assert all(row.x == plain_lines(logs[row.k]) for row in got)


def test_sections_and_wikilinks(spark):
    frame = spark.createDataFrame([(1, "first part § ab § second part\n§ third§"), (2, None), (3, "")], "id int, note string")
    found = text.sections(frame, "id", "note").orderBy("no").collect()
    assert [(r.id, r.no, r.section) for r in found] == [(1, 0, "first part"), (1, 2, "second part")] and all(len(r.section_id) == 12 for r in found)
    links = spark.createDataFrame([("see [[Page|alias]] and [[ Page#part ]] or [[#part]], [[Two#a|b]] [[]] [[x",)], "t string").select(text.wikilinks(F.col("t")).alias("l")).first().l
    assert links == ["Page", "Two"]


def test_history_of_all_names(spark):
    events = spark.createDataFrame([(5, "fact:7"), (2, "7"), (9, "fact:7"), (1, "17"), (3, "note:7"), (4, "fact:key")], "event_id int, target_id string")
    targets = spark.createDataFrame([("7",), ("fact:7",), ("key",), (" ",), ("none",)], "target string")
    got = sorted((r.target, r.event_id) for r in recall.history_of(events, targets, 2).collect())
    assert got == [("7", 2), ("7", 5), ("fact:7", 2), ("fact:7", 5), ("key", 4)]


def test_deep_search(spark):
    facts = spark.createDataFrame([(k, f"word{k % 3} text", k / 100, (k % 5) / 10 if k % 4 else None, int(k % 10 == 9)) for k in range(60)], "id long, fact_value string, trust_score double, preference double, archived int")
    edges = spark.createDataFrame([(k, k % 6) for k in range(60)] + [(3, 5), (9, 5)], "fact_id long, entity_id long")
    entities = spark.createDataFrame([(k, f"E{k}") for k in range(6)], "entity_id long, name string")
    got = recall.deep_search(facts, edges, entities, ["WORD1"], ["E5", "E0"]).orderBy("place").collect()
    live = [r for r in facts.collect() if not r.archived]
    words = sorted((r for r in live if "word1" in r.fact_value), key=lambda r: (-r.trust_score * (1 + (r.preference or 0)), r.id))[:20]
    named = sorted((r for r in live if r.id % 6 in (0, 5) or r.id in (3, 9)), key=lambda r: (-r.trust_score, r.id))[:10]
    merged = [r.id for r in words] + [r.id for r in named if r.id not in {w.id for w in words}]
    assert [r.id for r in got] == merged[:15] and [r.place for r in got] == list(range(1, 16))


def test_deletion_keeps_tombstones(spark):
    tables = {"facts": spark.createDataFrame([(1, "fact:1"), (2, "fact:2")], "k int, ref string"), "raw": spark.createDataFrame([(1, "raw:1"), (3, "verbatim:1"), (4, "1"), (5, "11")], "k int, ref string")}
    left, stones = lifecycle.delete_memories(tables, spark.createDataFrame([("1",)], "id string"), 99)
    assert {n: sorted(r.k for r in df.collect()) for n, df in left.items()} == {"facts": [2], "raw": [5]}
    assert sorted((r.name, r.ref, r.deleted_s) for r in stones.collect()) == [("facts", "fact:1", 99), ("raw", "1", 99), ("raw", "raw:1", 99), ("raw", "verbatim:1", 99)]
    assert stones.where("ref = 'fact:1'").first().snapshot == '{"k":1,"ref":"fact:1"}'
