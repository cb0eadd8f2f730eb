"""Each training-data operator against a plain version, and on nulls, empties, ties, repeats, long texts, no rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cairn.llm import bpe, common, fingerprint, itq, licenses, lines, minhash, mixing, pii, quality, tokencount
from cairn.llm.common import components

from .conftest import EDGE, prose
from .plain import PlainFTRL, find, held_out, plain_alignment, plain_components, plain_copies, plain_features, plain_fingerprints, plain_lines, plain_section_tokens, plain_targets, shingle_set

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CODEC = bpe.Codec(bpe.rank_bytes(RANKS), public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


# components


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(5, 5), (None, 1)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {k: k for e in edges for k in e if k is not None}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    got = {row.node: row.root for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {k for a, b in edges if a is not None and b is not None and a != b for k in (a, b)}
    assert got == {k: find(parent, k) for k in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def vectors():
    r = np.random.default_rng(1)
    base = r.standard_normal((60, 16))
    near = [base[k % 3] + 0.05 * r.standard_normal(16) for k in range(40)]
    rows = [(k, v.tolist()) for k, v in enumerate([*base, *near, base[0], 3 * base[1]])]
    return rows + [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, [1.0, 2.0]), (905, [float("inf")] + [1.0] * 15), (None, base[5].tolist()), (0, base[0].tolist())]


def test_itq(spark):
    rows = vectors()
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("x"))).collect()
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    parent = {k: k for k in range(len(good))}
    for a, b in zip(*np.nonzero(linked)):
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(good):
        if i is not None:
            least[find(parent, k)].append(i)
    want = [(i, int(linked[k].sum()), min(least[find(parent, k)])) for k, (i, _) in enumerate(good)]
    want += [(i, 0, i) for i in range(900, 906)]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_itq_recall_at_the_threshold(spark):
    """Pairs of 64 dimensions at a cosine just over 0.95, each apart from all others: the hardest links to find."""
    r = np.random.default_rng(11)
    a = itq.units(r.standard_normal((1500, 64)))
    side = r.standard_normal((1500, 64))
    side = itq.units(side - (side * a).sum(axis=1)[:, None] * a)
    both = np.vstack([a, 0.9501 * a + np.sqrt(1 - 0.9501**2) * side])
    rows = [(k, v.tolist()) for k, v in enumerate(both)]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert 0.98 * 3000 <= got.agg(F.sum("n_links")).first()[0] <= 3000


def test_itq_compares_vectors_of_every_length(spark):
    r = np.random.default_rng(12)
    rows = [(k, r.standard_normal(8).tolist()) for k in range(30)]
    for k, dim in ((100, 3), (200, 1500), (300, 1)):
        v = r.standard_normal(dim)
        rows += [(k, v.tolist()), (k + 1, (v + 0.01 * r.standard_normal(dim) * (dim > 1)).tolist()), (k + 2, (-v).tolist())]
    got = {x.vec_id: (x.n_links, x.component_id) for x in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k in (100, 200, 300):
        assert [got[k + j] for j in range(3)] == [(1, k), (1, k), (0, k + 2)]


def test_itq_large_buckets(spark, monkeypatch):
    """Many near copies, compared in pairs of small blocks, and many equal rows."""
    monkeypatch.setattr(itq, "BLOCK", 16)
    r = np.random.default_rng(13)
    v = itq.units(r.standard_normal((1, 32)))[0]
    rows = [(k, (v + 0.01 * r.standard_normal(32)).tolist()) for k in range(120)] + [(500 + k, (-v).tolist()) for k in range(300)]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((x.n_links, x.component_id) == ((119, 0) if x.vec_id < 500 else (299, 500)) for x in got)


def test_itq_plans_longer_substrings_for_more_vectors():
    for count in (10, 10**6, 10**7, 10**9):
        bits, tables = itq.plan_tables(count, 0.95)
        assert count / 2**bits <= itq.BUCKET and (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= itq.MISSED


# 2


def test_bpe_is_tiktoken(docs):
    frame = docs(*EDGE)
    got = bpe.bpe_digests(frame, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in EDGE:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = bpe.bpe_encode(frame, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in bpe.bpe_decode(encoded, RANKS, public_tokenizers.PATTERN).collect()) == sorted((t or "").encode() for _, t in EDGE)
    assert bpe.bpe_digests(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_random_bytes_and_clearing_memos(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 8)
    r = random.Random(5)
    for _ in range(2000):
        data = bytes(r.randrange(256) if r.random() < 0.5 else r.choice(b"the an ing 12") for _ in range(r.randint(1, 24)))
        assert CODEC.encode_bytes(data) == bpe.merge(data, CODEC.ranks)
    assert CODEC.encode("a" * 5000) == TIKTOKEN.encode_ordinary("a" * 5000)


# 3


@pytest.mark.parametrize("repeats", [False, True])
def test_lines(docs, repeats):
    r = random.Random(2)
    words = [f"t{k}" for k in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(1, 30))] for _ in range(12)]
    rows = [x for x in EDGE if x[0] is not None] if not repeats else list(EDGE)
    for k in range(60):
        text = []
        for _ in range(4):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = r.choice(words)
            text.append((" " if r.random() < 0.8 else "  \t").join(line))
        rows.append((100 + k, "\n".join(text)))
    rows += [(100, rows[-1][1] + "\nmore"), (-3, rows[20][1])] * repeats  # one id with two texts, and a negative one
    hashes = {x.text: x.h for x in docs(*rows).select("text", F.xxhash64("text").alias("h")).collect()}
    want = plain_lines(rows, hashes)
    got = lines.line_report(docs(*rows)).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append((0 if t is None else len(t.split("\n")), want[i, t]))
    for row in got:
        assert (row.n_lines, list(row.removed)) in texts[row.doc_id] and row.n_removed == len(row.removed)
    kept = lines.remove_lines(docs(*rows))
    assert kept.columns == docs().columns
    plain = []
    for i, t in rows:
        out = t if t is None or not want[i, t] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i, t])
        if t is None or not want[i, t] or out.strip():
            plain.append((i, out))
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(plain, key=str)
    assert lines.line_report(docs()).count() == 0


def test_tokens_are_named_by_one_lambda(docs):
    steps = F.split(F.lit(",".join(str(k % 100) for k in range(lines.BUCKETS))), ",").cast("array<bigint>")
    rows = docs((1, "b a  A\tc b"), (2, "C b a"), (3, "a d"))
    found = rows.select("doc_id", lines.token_set(F.col("text"), steps).alias("tokens"))
    assert found._jdf.queryExecution().analyzed().toString().count("transform(") == 1
    sets = {x.doc_id: x.tokens for x in found.collect()}
    assert sets[1] == sets[2] and len(sets[1]) == 3 and len(set(sets[1]) & set(sets[3])) == 1
    assert all(list(x) == sorted(x) for x in sets.values())


# 4


def test_quality(docs, spark):
    good = [(k, prose(k, 40 + k % 60)) for k in range(150)]
    bad = [(1000 + k, " ".join((w.upper() + "!!") for w in prose(k, 40).split())) for k in range(75)] + [(2000 + k, "\n".join(f"| {w} |" for w in prose(k, 30).split())) for k in range(75)]
    frame = docs(*good, *bad, *EDGE)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(frame, labels).collect() if r.doc_id is not None and (r.doc_id < 10 or r.doc_id >= 10)}
    rows = quality.quality_scores(frame, labels).collect()
    assert len(rows) == frame.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0 and i > 9]
    assert sum(got[i].predicted == int(i < 1000) for i in held) >= 0.95 * len(held)
    assert [r.score for r in sorted(rows, key=str)] == [r.score for r in sorted(quality.quality_scores(frame, labels).collect(), key=str)]
    assert quality.quality_scores(docs(), labels.limit(0)).count() == 0
    assert {r.score for r in quality.quality_scores(frame, labels.limit(0)).collect()} == {0.5}


def test_quality_is_the_plain_model(docs, spark, monkeypatch):
    rows = [(k, prose(k, 20 + k % 17)) for k in range(40)] + [(100 + k, " ".join(w.upper() + "!!" for w in prose(k, 15).split()) + " 12 12 \u00e9a aB") for k in range(40)] + [(200, ""), (201, None), (202, "\U0001f600")]
    for _, t in rows:
        index, value = quality.features(t or "")
        want = sorted((k, v) for k, vs in plain_features(t or "").items() for v in vs)
        mine = sorted(zip(index.tolist(), value.tolist()))
        assert [k for k, _ in mine] == [k for k, _ in want] and [v for _, v in mine] == pytest.approx([v for _, v in want])
    labels = {i: int(i < 100) for i, _ in rows if i < 200}
    frame = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    hashes = {x.doc_id: x.h for x in frame.select("doc_id", F.xxhash64("doc_id", "quality").alias("h")).collect()}
    texts, model = dict(rows), PlainFTRL()
    for _ in range(quality.ROUNDS):
        for i in sorted((i for i in labels if not held_out(i)), key=hashes.get):
            model.learn(plain_features(texts[i]), labels[i])
    got = {x.doc_id: x.score for x in quality.quality_scores(docs(*rows), frame).collect()}
    assert got == pytest.approx({i: model.score(plain_features(t or "")) for i, t in rows}, abs=1e-5)


# 5


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts(docs, rule):
    got = tokencount.count_by_section(docs(*EDGE), tokencount.line_lengths(F.col("text")), RANKS, public_tokenizers.PATTERN, rule).collect()
    assert len(got) == len(EDGE)
    want = collections.Counter((i, len(TIKTOKEN.encode_ordinary(t or "")), len((t or "").split("\n"))) for i, t in EDGE)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_sections) for r in got) == want
    assert all(sum(r.section_tokens) == pytest.approx(r.n_tokens) for r in got)
    plain = []
    for i, t in EDGE:
        tokens = TIKTOKEN.decode_tokens_bytes(TIKTOKEN.encode_ordinary(t or ""))
        plain.append((str(i), *plain_section_tokens(t or "", tokens, [len(x) + 1 for x in (t or "").split("\n")], rule)))
    found = sorted((str(r.doc_id), list(r.section_tokens), r.n_crossing) for r in got)
    for a, b in zip(found, sorted(plain)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == b[2]


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts_of_any_sections(docs, rule):
    """Sections that cut words and characters of several bytes."""
    r = random.Random(9)
    text = lambda: "".join(r.choice(["the ", "\u00e9\u4e2d", "\U0001f600", "token", "\n\n", " 12345 ", "x"]) for _ in range(r.randint(1, 60)))
    rows = [(k, text()) for k in range(60)]
    cuts = {k: [r.randint(0, 9) for _ in range(r.randint(1, 40))] for k, _ in rows}
    frame = docs(*rows).withColumn("cuts", F.create_map([x for k, v in cuts.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("doc_id")])
    for x in tokencount.count_by_section(frame, F.col("cuts"), RANKS, public_tokenizers.PATTERN, rule).collect():
        t = dict(rows)[x.doc_id]
        want = plain_section_tokens(t, TIKTOKEN.decode_tokens_bytes(TIKTOKEN.encode_ordinary(t)), cuts[x.doc_id], rule)
        assert list(x.section_tokens) == pytest.approx(want[0]) and x.n_crossing == want[1]


def test_allocation_rules():
    starts, ends, edges = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 6, 9])
    assert tokencount.allocate(starts, ends, edges, "start")[0].tolist() == [2, 1, 0]
    assert tokencount.allocate(starts, ends, edges, "majority")[0].tolist() == [1, 1, 1]
    assert tokencount.allocate(starts, ends, edges, "share")[0].tolist() == pytest.approx([1 + 1 / 3, 2 / 3 + 1 / 4, 3 / 4])
    text = "é中😀 x" * 5
    ids = CODEC.encode(text)
    a, b = tokencount.token_spans(text, np.array([CODEC.lengths[i] for i in ids]))
    assert a[0] == 0 and b[-1] == len(text) and (b[:-1] >= a[1:]).all() and (b > a).all()


def test_token_counts_of_fields(docs):
    text, lengths = tokencount.fields(["lang", "text"])
    frame = docs((1, "hello world"), (2, None)).withColumn("lang", F.lit("en")).withColumn("both", text)
    got = {r.doc_id: list(r.section_tokens) for r in tokencount.count_by_section(frame, lengths, RANKS, public_tokenizers.PATTERN, "start", text_col="both").collect()}
    assert [len(v) for v in got.values()] == [2, 2]


# 6


def near_rows():
    r = random.Random(4)
    rows = [*EDGE, (4, prose(9, 60))]
    for k in range(90):
        words = prose(k % 6 + 20, 80).split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = "zz"
        rows.append((100 + k, " ".join(words).title() if k % 9 == 0 else "\n".join(words)))
    return rows


def test_minhash(docs, monkeypatch):
    rows = near_rows()
    want, _ = plain_components(rows, 85)
    for block in (256, 16):  # 16: the groups are compared in pairs of blocks
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(docs(*rows)).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(want)
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs()).count() == 0


def test_minhash_many_equal_rows_and_copies(docs, spark, monkeypatch):
    """Equal rows are one text wherever texts are compared, and a group of near copies is joined though no block holds it."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(7)
    texts = []
    for _ in range(60):
        words = prose(50, 200).split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(200)] = f"q{r.randrange(50)}"
        texts.append(" ".join(words))
    far = " ".join(prose(50, 200).split()[:110] + prose(60, 90).split())
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, far), (1001, far + " end")]
    frame = docs(*rows).unionByName(docs((2000, prose(70, 90))).crossJoin(spark.range(50_000).select()))
    frame = frame.unionByName(docs((2001, prose(70, 90) + " tail")))
    seen = []
    exact = minhash.exact_edges
    monkeypatch.setattr(minhash, "exact_edges", lambda t, w, p: seen.append(t.num_rows) or exact(t, w, p))
    got = minhash.near_duplicates(frame)
    want, _ = plain_components([*rows, (2000, prose(70, 90)), (2001, prose(70, 90) + " tail")], 85)
    assert sorted({(x.doc_id, x.n_shingles, x.component_id) for x in got.distinct().collect()}) == sorted(want)
    assert got.count() == len(rows) + 50_001


@pytest.mark.parametrize("block", [2, 4, 512])
def test_confirmed_edges_lose_no_link(docs, spark, monkeypatch, block):
    """Rough components of texts that full sets join only in part."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(block)
    rows = []
    for k in range(40):
        words = prose(k % 3, 60).split()
        for _ in range(r.randint(0, 9)):
            words[r.randrange(60)] = f"q{r.randrange(9)}"
        rows.append((k, " ".join(words)))
    signed = minhash.signatures(docs(*rows), "doc_id", "text", 5).dropDuplicates(["cls"])
    linked = signed.select(F.col("id").alias("node"), "cls", F.lit(0).cast("long").alias("root"), "id", "th")
    texts = docs(*rows).select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_th"), F.col("text").cast("binary").alias("text"))
    marks = signed.select(F.col("id").alias("node"), "bands", "sketch")
    edges = minhash.confirmed_edges(linked, marks, texts, 5, 85)
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    roots = {x.node: x.root for x in components(found).collect()}
    least = {x.node for x in linked.select("node").collect()}
    want = {i: c for i, _, c in plain_components([x for x in rows if x[0] in least], 85)[0]}
    assert {i: roots.get(i, i) for i in least} == want


def test_minhash_chain_moves_texts_by_candidates(docs, monkeypatch):
    """A chain of texts of which neighbours are alike at 0.77, seldom at 0.9: one rough component, few texts a task, the right links."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    at, starts = 0, []
    for k in range(2_000):
        starts.append(at)
        at += 5 if k % 7 == 0 else 13
    rows = [(k, " ".join(f"c{w}" for w in range(s, s + 104))) for k, s in enumerate(starts)]
    counts, fetch = [], minhash.wanted
    monkeypatch.setattr(minhash, "wanted", lambda nodes, apart: counts.append((nodes, apart)) or fetch(nodes, apart))
    frame = docs(*rows)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame).collect()}
    want, sets = {}, [shingle_set(t) for _, t in rows]
    for k in range(len(rows)):  # texts that are not neighbours share fewer shingles
        linked = k and 100 * len(sets[k] & sets[k - 1]) >= 85 * len(sets[k] | sets[k - 1])
        want[k] = want[k - 1] if linked else k
    assert got == want
    signed = minhash.signatures(frame, "doc_id", "text", 5)
    nodes = signed.select(F.col("id").alias("node"), F.col("id").alias("part"), F.lit(False).alias("told"), "bands", "sketch")
    assert counts and fetch(nodes, counts[0][1]).count() <= 6 * len(rows)
    assert fetch(nodes.withColumn("told", F.lit(True)), counts[0][1]).count() == 0
    assert fetch(nodes.withColumn("part", F.lit(0).cast("long")), counts[0][1]).count() == 0


def test_keep_one(docs):
    rows = near_rows()
    _, roots = plain_components(rows, 80)
    wordless = [i for i, t in rows if not shingle_set(t)]
    got = minhash.keep_one(docs(*rows))
    assert got.columns == docs().columns
    assert got.count() == len({r for r, (_, t) in zip(roots, rows) if shingle_set(t)}) + len(wordless)
    assert minhash.keep_one(docs()).count() == 0


# 7


def test_fingerprints(docs):
    """Against sets of hashes in the order of the rows: descending id, nulls last, then the text's hash; the last is followed by the first."""
    rows = [*EDGE, (4, "two words"), (-7, "negative"), *((50 + k, prose(k, 50 + 7 * k)) for k in range(40))]
    hashes = {x.doc_id: x.h for x in docs(*((k, t) for k, (_, t) in enumerate(rows))).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0), hashes[k]))
    hexed = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
    want = [(str(i), n, hashlib.sha256(e.encode()).hexdigest(), hexed(own), hexed(changed), round(a, 9), round(b, 9)) for i, n, e, own, changed, a, b in plain_fingerprints([rows[k] for k in order])]
    got = fingerprint.edited_fingerprints(docs(*rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    assert fingerprint.edited_fingerprints(docs()).count() == 0
    one = fingerprint.edited_fingerprints(docs((3, "a b c d"))).first()
    assert one.n_chars == 7 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def test_sketches_tell_the_similarity(docs):
    rows = [(k, prose(k, 3000)) for k in (1, 2)] + [(3, " ".join(prose(1, 2500).split() + prose(2, 600).split()))]
    sets = {i: shingle_set(t) for i, t in rows}
    for r in docs(*rows).select("doc_id", fingerprint.likeness(fingerprint.sketch(F.col("text")), fingerprint.sketch(F.lit(rows[0][1]))).alias("l")).collect():
        assert r.l == pytest.approx(len(sets[r.doc_id] & sets[1]) / len(sets[r.doc_id] | sets[1]), abs=0.05)


def test_sketches_merge(docs):
    x, y = F.lit(prose(1, 300)), F.lit(prose(2, 300))
    row = docs((1, "")).select(
        fingerprint.merge(fingerprint.sketch(x), fingerprint.sketch(y)).alias("m"), F.sort_array(F.array_union(fingerprint.sketch(x), fingerprint.sketch(y))).alias("u"),
        fingerprint.containment(fingerprint.sketch(x), fingerprint.merge(fingerprint.sketch(x), fingerprint.sketch(y))).alias("c"),
    ).first()
    assert row.m == row.u and row.c == 1.0


# 8


def test_licenses(docs, spark):
    mit, gpl = licenses.TEMPLATES["mit-grant"], licenses.TEMPLATES["gpl-3.0-short"]
    changed = mit.split()
    changed[10] = "REPLACED"
    del changed[40]
    rows = [*EDGE, (50, f"{prose(3, 50)}\n{gpl} {prose(4, 20)}"), (51, f"é {prose(5, 9)} {' '.join(changed)} end"), (52, f"{gpl} {gpl}"), (53, " ".join(mit.split()[:20]))]
    got = collections.defaultdict(list)
    for r in licenses.scan(docs(*rows), licenses.templates_frame(spark)).collect():
        got[r.doc_id].append((r.template, r.matched, round(r.coverage, 3), r.start, r.end))
    text = dict(rows)
    assert set(got) == {50, 51, 52}
    (name, matched, coverage, a, b), = got[50]
    assert (name, matched, coverage, text[50][a:b]) == ("gpl-3.0-short", len(gpl.split()), 1.0, gpl)
    (name, matched, coverage, a, b), = got[51]
    n = len(mit.split())
    assert name == "mit-grant" and matched == n - 2 and text[51][a:b] == " ".join(changed)
    assert [text[52][a:b] for *_, a, b in sorted(got[52], key=lambda x: x[3])] == [gpl, gpl]
    assert licenses.scan(docs(), licenses.templates_frame(spark)).count() == 0
    assert licenses.scan(docs(*rows), licenses.templates_frame(spark).limit(0)).count() == 0


def test_band_alignment_is_a_longest_common_subsequence():
    r = np.random.default_rng(2)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(3, 9)).astype(np.uint64), r.integers(0, 4, r.integers(3, 9)).astype(np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert licenses.align(a, b, [0])[0][0] == table[-1, -1]


def test_alignment_at_every_place(monkeypatch):
    monkeypatch.setattr(licenses, "BAND", 2)
    r = np.random.default_rng(5)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(3, 9)).astype(np.uint64), r.integers(0, 5, r.integers(0, 20)).astype(np.uint64)
        shifts = list(range(-len(a) - 3, len(b) + 3))
        for shift, (n, first, end) in zip(shifts, licenses.align(a, b, shifts)):
            assert n == plain_alignment(a.tolist(), b.tolist(), shift, 2)
            if n:  # the span that is reported holds as many, and no span ends before it that does
                inside = lambda lo, hi: plain_alignment(a.tolist(), b.tolist()[lo:hi], shift - lo, 2)
                assert inside(first, end) == n and inside(0, end - 1) < n


def test_licenses_of_whole_texts(docs, spark):
    """Each built-in text, in prose, with every 30th word changed, is found as itself or as one that is alike but for the change."""
    rows = []
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split()
        words[29::30] = ["CHANGED"] * len(words[29::30])
        rows.append((k, f"{prose(k, 20)} {' '.join(words)} {prose(k + 1, 20)}"))
    got = collections.defaultdict(list)
    for r in licenses.scan(docs(*rows), licenses.templates_frame(spark)).collect():
        got[r.doc_id].append((r.template, r.start, r.end))
    for k, name in enumerate(licenses.TEMPLATES):
        assert any(t == name or t.split("-")[0] in (name.split("-")[0], "gpl", "agpl", "lgpl", "isc", "0bsd") for t, _, _ in got[k]), name
    assert sum(any(t == name for t, _, _ in got[k]) for k, name in enumerate(licenses.TEMPLATES)) >= len(licenses.TEMPLATES) - 3


# 9


def test_mixing(docs):
    r = random.Random(1)
    rows = [(k, " ".join(["w"] * r.randint(1, 60)), r.choice(["a", "a", "a", "b", "c", None])) for k in range(1500)] + [(1, None, "a"), (None, "x y", "b"), (5000, "same text", "c"), (5000, "same text", "c"), (8, "", "z")]
    frame = docs(*rows)
    mixed = mixing.mix(frame, [3.0, 1.0, 2.0])
    got = mixed.collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert len(got) == len(rows) and all(x.source_size == sizes[x.source] and 0 <= x.taken <= 2 * x.size for x in got)
    targets = plain_targets(sizes, [3.0, 1.0, 2.0])
    for s, target in targets.items():
        assert all(x.target == pytest.approx(target) for x in got if x.source == s)
        assert sum(x.taken for x in got if x.source == s) == pytest.approx(target, rel=0.05, abs=60)
    keys = frame.select("doc_id", "source", F.xxhash64("text").alias("th"), mixing.word_count(F.col("text")).alias("size"))
    keys = keys.withColumns({"slice": F.pmod(F.xxhash64("doc_id", "size"), F.lit(mixing.SLICES)), "offset": F.pmod(F.xxhash64("source", F.lit(1)), F.lit(mixing.STEPS)) / mixing.STEPS}).collect()
    known, want = {(x.doc_id, x.th): x.copies for x in got}, collections.Counter()
    found = collections.Counter((x.doc_id, x.th, x.source, x.copies) for x in got)
    none = lambda v: (v is not None, v or 0)
    for s, target in targets.items():
        own = sorted((x for x in keys if x.source == s), key=lambda x: (math.floor(math.log2(max(x.size, 1)) * mixing.CLASSES_PER_DOUBLING), x.slice, x.size, none(x.doc_id), none(x.th)))
        for x, n in zip(own, plain_copies(own, target, sizes[s], own[0].offset)):
            want[x.doc_id, x.th, s, n] += 1
    assert found == want and len(known) <= len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame.repartition(7), [3.0, 1.0, 2.0]).collect()), key=str)
    emitted = mixing.emit(frame, mixed)
    assert emitted.columns == frame.columns
    assert collections.Counter((x.doc_id, x.text) for x in emitted.collect()) == +collections.Counter({k: n for k, n in _copies(got, rows).items()})
    assert mixing.mix(docs(), [1.0]).count() == 0


def _copies(got, rows):
    """Copies by id and text: equal rows together."""
    out = collections.Counter()
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    for x in got:
        t = next(t for t in texts[x.doc_id] if len((t or "").split()) == x.size)
        out[x.doc_id, t] += x.copies
    return out


# 10


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain_base(text):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, good) in enumerate(BASE) for m in pattern.finditer(text) if good(m.group()))


def test_base_patterns():
    r = random.Random(6)
    bits = ["a.b", "@", "x-1.com", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "+1 (663) 555-6869", " ", "-", "é", "7", "\n", "..", "@@", "1.2.3.4.5.6.7.8", "0008"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("1" * 100_000 + "a" * 100_000 + "@") == []


SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def planted(count):
    """Documents with personal data in forms with base patterns and without, secrets, and look-alikes: (id, text), and for each id what is in it."""
    r = random.Random(21)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows, inside = [], {}
    for k in range(count):
        words = prose(k, 40 + k % 50).split()
        what = None
        if k % 3 == 0:
            what = r.choice((f"jo.{d(2)}@mail{d(1)}.example.com", f"{r.randint(1, 250)}.{r.randint(1, 250)}.{r.randint(1, 250)}.{r.randint(1, 250)}", f"+1 ({d(3)}) 555-{d(4)}", "4111 1111 1111 1111"))
        elif k % 3 == 1:
            what = r.choice((f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"reach me: jo.{words[3]} [at] mail [dot] org", f"call ({d(3)}) {d(3)}-{d(4)}", f"card 4111.1111.1111.1111"))
        elif k % 9 == 2:
            words.insert(7, r.choice((f"version 999.998.{d(3)}.996", f"page {d(2)}-{d(2)}-{d(2)}", f"meet at noon. Then", "some_long_name_of_thing_42")))
        if what:
            words.insert(9, what)
            inside[k] = what
        rows.append((1000 + k, " ".join(words)))
    return rows, {1000 + k: what for k, what in inside.items()}


def test_pii(docs, spark):
    rows, inside = planted(900)
    model = pii.fit(docs(*rows))
    more = [*EDGE, (5000, "mail \u00e9 a.b@x.org or call (663) 555-6869, card 4111.1111.1111.1111 ok"), (5001, "version 999.998.997.996 page 12-34-56"), (5002, f'the token = "{SECRET}" was')]
    got = {r.doc_id: r for r in pii.personal_data(docs(*rows, *more), model).collect()}
    for i, t in rows + more:
        if i is not None:
            base = plain_base(t or "")
            written = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in base)
            assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
            assert set(filter(None, written.split(","))) <= set(got[i].spans.split(","))
            assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
            assert got[i].n_spans == len(got[i].found) == len([x for x in got[i].spans.split(",") if x])
    added = {(x.kind, more[-3][1][x.start : x.end]) for x in got[5000].found if x.added}
    assert added == {("phone", "(663) 555-6869"), ("card", "4111.1111.1111.1111")}
    assert got[5001].spans == "" and got[5002].spans == f"secret:13:{13 + len(SECRET)}"
    assert {r.doc_id: r.redacted for r in pii.redact(docs(*more), model).collect()}[5000] == "mail \u00e9 [email] or call [phone], card [card] ok"
    assert sum(got[k].n_spans > 0 for k in inside) >= 0.95 * len(inside)
    clean = [k for k, _ in rows if k not in inside]
    assert sum(got[k].n_spans == 0 for k in clean) >= 0.98 * len(clean)
    only_added = [k for k in inside if k % 3 == 2]
    assert sum(any(x.added for x in got[k].found) for k in only_added) >= 0.9 * len(only_added)
    assert pii.personal_data(docs(), model).count() == 0


def test_pii_of_no_rows(docs):
    model = pii.fit(docs())
    assert [r.spans for r in pii.personal_data(docs((1, "a@b.org and call (663) 555-6869")), model).collect()] == ["email:0:7"]


def test_trees_are_those_of_spark(docs):
    rows = pii.training_rows(docs(*planted(300)[0]), 300, 7, "doc_id", "text").cache()
    fitted = pii.train(rows, 7)
    assert {x.label for x in rows.select("label").distinct().collect()} == {0.0, 1.0}
    told = fitted.transform(rows.select("features", pii.array_to_vector("features").alias("v")).withColumnsRenamed({"features": "raw", "v": "features"})).select("raw", "probability").collect()
    mine = pii.Model(pii.trees_of(fitted), []).probabilities(np.array([x.raw for x in told]))
    assert mine == pytest.approx([float(x.probability[1]) for x in told], abs=1e-9)
    assert len(fitted.trees) == 16


def test_calibration():
    p, labels = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.4]), np.array([1.0, 1.0, 1.0, 0.0, 1.0, 1.0])
    assert pii.calibrated(p, labels, 0.99) == 0.8 and pii.calibrated(p, labels, 0.75) == 0.6 and pii.calibrated(p[3:4], labels[3:4], 0.5) == 1.1 and pii.calibrated(p[:0], labels[:0], 0.5) == 1.1


# names


def test_other_columns_stay_whatever_their_names(docs, spark):
    """Columns by the names that operators use themselves."""
    names = ["_k", "_id", "_removed", "_h", "_th", "_n", "row", "key", "number", "copies", "removed", "g_id", "g_th", "score", "text_", "place", "dotted.name"]
    rows = [(k, "\n".join([prose(k % 4, 12), prose(k, 9)])) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    for k, n in enumerate(names):
        frame = frame.withColumn(n, F.lit(f"v{k}"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    outs = {
        "emit": mixing.emit(frame, mixing.mix(frame, [1.0])), "keep_good": quality.keep_good(frame, labels, threshold=0.0), "remove_lines": lines.remove_lines(frame), "keep_one": minhash.keep_one(frame),
    }
    for name, out in outs.items():
        assert out.columns == frame.columns, name
        got = out.collect()
        assert got and all([x[n] for n in names] == [f"v{k}" for k in range(len(names))] for x in got), name


# shared folder


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        def __init__(self, master, found=None):
            self.conf, self.sparkContext = self, self
            self.master, self.found, self.applicationId = master, found, master

        def get(self, name, default):
            return self.found or default

    assert common.shared_folder(Session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    assert common.shared_folder(Session("local[2]")) == common.shared_folder(Session("local[2]")) != ""
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.shared_folder(Session(master))
