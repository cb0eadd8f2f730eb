"""Rules that end facts, and replaced memories, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from cairn.operators import conflicts

RULES = [(0, "old", "(开启|启用|open|enable)", ["开启", "启用", "open", "enable"]), (0, "new", "(关闭|禁用|close|disable)", ["关闭", "禁用", "close", "disable"])]
RULES += [(1, "old", "(关闭|禁用|close|disable)", ["关闭", "禁用", "close", "disable"]), (1, "new", "(开启|启用|open|enable)", ["开启", "启用", "open", "enable"])]
RULES += [(k, side, f"{side}name{k}\\b", [f"{side}name{k}"]) for k in range(2, 300) for side in ("old", "new")]


def test_texts_end_older_facts(spark, monkeypatch):
    r = random.Random(3)
    words = ["OPEN", "it is", "disable", "关闭", "启用", "oldname7", "newname7", "oldname70", "newname70", "Oldname12.", "newname12", "plain", "opening"]
    facts = [(k, r.choice(["t", "t", "u", None]), r.randrange(400) * 1000, " ".join(r.choice(words) for _ in range(r.randrange(4))), r.choice([None, None, 150_000])) for k in range(250)] + [(900, "t", 5, None, None)]
    found = {side: {(i, rule) for i, _, _, v, _ in facts for rule, s, p, _ in RULES if s == side and v and re.search(p, v, re.IGNORECASE)} for side in ("old", "new")}
    want = {}
    for i, tenant, at, _, until in facts:
        ends = [(t, j, rule) for _, rule in [x for x in found["old"] if x[0] == i] for j, own, t, _, _ in facts if (j, rule) in found["new"] and own == tenant and (t, j) > (at, i)]
        # Of one rule's texts only the first counts: a fact that was not valid then is not valid later.
        ends = [e for e in ends if until is None or e[0] < until]
        if ends:
            want[i] = min(ends)
    frame = spark.createDataFrame(facts, "id long, tenant string, at_s long, value string, valid_to_s long")
    rules = spark.createDataFrame(RULES, "rule long, side string, pattern string, literals array<string>")
    for few in (50_000, 3):
        monkeypatch.setattr(conflicts, "FEW_LITERALS", few)
        got = {x.fact_id: (x.closed_s, x.by_id, x.rule) for x in conflicts.resolve_conflicts(frame, frame, rules).collect()}
        assert got == want and len({w[2] for w in want.values()}) >= 4
    assert conflicts.resolve_conflicts(frame.limit(0), frame, rules).count() == 0


def plain_states(edges):
    nxt = {}
    for old, new in edges:
        if old != new:
            nxt[old] = max(new, nxt.get(old, new))
    out = {}
    for k in {x for e in edges for x in e}:
        path = [k]
        while path[-1] in nxt and nxt[path[-1]] not in path:
            path.append(nxt[path[-1]])
        end = max(path[path.index(nxt[path[-1]]) :]) if path[-1] in nxt else path[-1]
        out[k] = ("active" if k == end else "superseded", end)
    return out


def test_chains_and_circles_of_replacements(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 170)] + [(300, 301), (301, 302), (302, 300), (310, 300), (999, 310), (5, 5), (7, 8), (7, 9), (8, 7)]
    edges += [(r.randrange(400, 460), r.randrange(400, 460)) for _ in range(60)]
    got = {x.memory_id: (x.state, x.successor) for x in conflicts.live_successors(spark.createDataFrame(edges, "old_id long, new_id long").withColumn("next", F.lit(1))).collect()}
    assert got == plain_states(edges)
    assert got[100] == ("superseded", 170) and got[999] == ("superseded", 302) and got[302] == ("active", 302)
    assert conflicts.live_successors(spark.createDataFrame([], "old_id long, new_id long")).count() == 0
