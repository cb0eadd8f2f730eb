"""The best-match join against brute force and against the block join."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import matches, similar


def brute(left, right, least):
    out = {}
    for i, key, grams, before in left:
        for m, other, more, at in right:
            if key == other and grams and more and i != m and (before is None or at < before):
                a, b = set(grams), set(more)
                s = len(a & b) / len(a | b)
                if s >= least and (i not in out or (s, -at) > (out[i][1], -out[i][2])):
                    out[i] = (m, s, at)
    return {(i, m, round(s, 9)) for i, (m, s, _) in out.items()}


def rows(seed, n, own=True):
    r = random.Random(seed)
    bases = [r.sample(range(200), r.randrange(1, 60)) for _ in range(14)]
    out = []
    for k in range(n):
        grams = set(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 3, 9, 20])):
            grams ^= {r.randrange(200)}
        out.append((k, r.choice(["hot", "hot", "hot", "b", None]), sorted(grams)))
    return out + [(n + k, "hot", [1, 2, 3]) for k in range(40)] + [(n + 90, "b", []), (n + 91, "b", [7]), (n + 92, None, [7]), (n + 93, "c", list(range(5000)))]


def frames(spark, left, right):
    extra = lambda df: df.withColumns({"key": F.lit("x"), "n": F.lit(1), "t": F.lit("t"), "c": F.lit(0)})
    return extra(spark.createDataFrame(left, "id long, k string, grams array<long>, before long")), extra(spark.createDataFrame(right, "match_id long, k string, grams array<long>, at long"))


@pytest.mark.parametrize("least", [1.0, 0.85, 0.5])
def test_best_match(spark, least):
    base = rows(1, 220)
    left, right = [(i, k, g, None) for i, k, g in base], [(i, k, g, i) for i, k, g in base]
    l, r = frames(spark, left, right)
    got = {(x.id, x.match_id, round(x.similarity, 9)) for x in matches.best_match(l, r, ["k"], least).collect()}
    assert got == brute(left, right, least) and len(got) > 60


def test_best_match_before(spark):
    base = rows(2, 150)
    r = random.Random(5)
    left, right = [(i, k, g, r.choice([None, r.randrange(200)])) for i, k, g in base], [(1000 + i, k, g, 199 - i) for i, k, g in rows(3, 150)]
    l, rr = frames(spark, left, right)
    got = {(x.id, x.match_id, round(x.similarity, 9)) for x in matches.best_match(l, rr, ["k"], 0.7).collect()}
    assert got == brute(left, right, 0.7) and len(got) > 40
    assert got == {(x.id, x.match_id, round(x.similarity, 9)) for x in similar.best_similar(l.drop("key", "n", "t", "c"), rr.drop("key", "n", "t", "c"), ["k"], 0.7).collect()}
    assert matches.best_match(l.limit(0), rr, ["k"], 0.7).count() == 0 and matches.best_match(l, rr.limit(0), ["k"], 0.7).count() == 0


def test_a_group_of_copies_is_two_rows_of_the_block_join(spark, monkeypatch):
    seen = []
    real = matches.best_similar
    monkeypatch.setattr(matches, "best_similar", lambda l, r, *a: seen.extend([l.count(), r.count()]) or real(l, r, *a))
    base = [(k, "hot", [1, 2, 3, 4]) for k in range(3000)] + [(9000, "hot", [1, 2, 3, 4, 5])]
    l, r = frames(spark, [(i, k, g, None) for i, k, g in base], [(i, k, g, i) for i, k, g in base])
    got = {x.id: (x.match_id, x.similarity) for x in matches.best_match(l, r, ["k"], 0.7).collect()}
    assert got[0] == (1, 1.0) and all(got[k] == (0, 1.0) for k in range(1, 3000)) and got[9000] == (0, 0.8)
    assert seen == [1, 3]


def test_parts_of_a_block_give_what_the_block_gives():
    base = [(i, g) for i, _, g in rows(4, 120) if g]
    table = lambda name, other, values: pa.table({name: pa.array([i for i, _ in base], pa.int64()), "grams": pa.array([g for _, g in base], pa.list_(pa.int64())), other: pa.array(values, pa.int64())})
    left, right = table("id", "before", [None if i % 3 else 60 for i, _ in base]), table("match_id", "at", [i for i, _ in base])

    def best(part):
        out = {}
        for x in similar._best(left, right, 0.5, part).to_pylist():
            out[x["id"]] = max(out.get(x["id"], (0, 0, 0)), (x["similarity"], -x["at"], x["match_id"]))
        return out

    assert best(7) == best(10_000) and len(best(7)) > 40


def test_a_row_is_shuffled_to_few_blocks(spark):
    base = [(k, "hot", [k, k + 1, 9_000], None) for k in range(3_000)]
    l, r = frames(spark, base, [(i, k, g, i) for i, k, g, _ in base])
    got = similar.best_similar(l.drop("key", "n", "t", "c"), r.drop("key", "n", "t", "c"), ["k"], 0.5)
    assert got.count() == 3_000
    assert similar.BLOCK >= 3_000  # with blocks of 512 rows each went to six


def test_far_rows_are_not_compared(monkeypatch):
    """Two vocabularies and two sizes: bounds leave out most pairs and no best row; equal similarities go to the least at."""
    r, seen, real = random.Random(8), [], similar._overlaps
    monkeypatch.setattr(similar, "_overlaps", lambda *a: seen.append(real(*a)) or seen[-1])
    kinds = [(0, 40), (0, 150), (10_000, 40), (10_000, 150)]
    make = lambda k: sorted({first + g for first, size in [kinds[k % 4]] for g in r.sample(range(size * 5 // 4), size)})
    left, right = [(k, make(k), r.choice([None, 900])) for k in range(400)], [(1_000 + k, make(k), 999 - k) for k in range(400)]
    right += [(k + 500, grams, at + 1_000) for k, grams, at in right]
    table = lambda rows, *names: pa.table(dict(zip(names, map(pa.array, zip(*rows)))))
    found = similar._best(table(left, "id", "grams", "before"), table(right, "match_id", "grams", "at"), 0.5, 50).to_pylist()
    want = brute([(i, "x", g, b) for i, g, b in left], [(m, "x", g, at) for m, g, at in right], 0.5)
    assert {(x["id"], x["match_id"], round(x["similarity"], 9)) for x in found} == want and len(want) > 300
    assert sum(np.size(x) for x in seen) < 0.4 * len(left) * len(right)
