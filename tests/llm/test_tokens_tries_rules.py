"""Cross-tokenizer alignment, the prefix trie and the quality rules against plain loops."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cairn.llm import common, crosstok, qualityrules, queries, trie

from .conftest import EDGE, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in t)


# 11


def byte_of(letter):
    if 33 <= ord(letter) < 127 or 161 <= ord(letter) < 173 or 174 <= ord(letter) < 256:
        return ord(letter)
    return [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256)][ord(letter) - 256]


def plain_tokens(texts):
    """For each text the (id, bytes) of both tokenizers, or two empty lists."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    out = []
    for t in texts:
        x = [(k, bytes(byte_of(c) for c in a.id_to_token(k))) for k in a.encode(" " + (t or ""), add_special_tokens=False).ids]
        y = [(k, bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(t or "")]
        whole = b" " + (t or "").encode()
        same = t and b"".join(p for _, p in x) == whole == b"".join(p for _, p in y)
        out.append((x, y) if same else ([], []))
    return out


def spans(tokens):
    at, out = 0, []
    for k, data in tokens:
        out.append((k, at, at + len(data)))
        at += len(data)
    return out


def plain_alignments(texts):
    links, groups = [], []
    for x, y in plain_tokens(texts):
        x, y = spans(x), spans(y)
        links.append([(i, j) for i, a, b in x for j, c, d in y if a < d and c < b] if len(x) < 400 else [(i, j) for i, a, b in x for j, c, d in y[max(0, len([0 for t in y if t[2] <= a])) :][: b - a + 1] if a < d and c < b])
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        parts = [([k for k, a, b in x if lo < b <= hi], [k for k, a, b in y if lo < b <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        groups.append(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in parts))
    count = collections.Counter(pair for one in links for pair in one)
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(len(x), len(y), g.count(";") + bool(g), len(one), sum(count[p] == best[p[1]] for p in one), sum(count[p] for p in one), g) for (x, y), one, g in zip(plain_tokens(texts), links, groups)]


TEXTS = [*EDGE[:8], *EDGE[9:], (20, "▁ a piece sign"), (21, "a  b\n\n c\td <s> <unk> <0x41> <|endoftext|> \x00z"), (22, "  lead ﬁ Å \r\n 　 é"), (23, "\U0001f468‍\U0001f469‍\U0001f467 fin"), (24, prose(5, 60)), (25, prose(5, 60))]


def test_crosstok(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 64)
    monkeypatch.setattr(crosstok, "HELD", 300)
    got = crosstok.align(docs(*TEXTS).repartition(3), A, B, public_tokenizers.PATTERN).collect()
    want = [(i, *x) for (i, _), x in zip(TEXTS, plain_alignments([t for _, t in TEXTS]))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) > 8 and want[[i for i, _ in TEXTS].index(20)][1] == 0
    assert crosstok.align(docs(), A, B).count() == 0
    assert crosstok.align(docs((1, None), (2, "")), A, B).select("doc_id", "n_a", "groups").orderBy("doc_id").collect() == [(1, 0, ""), (2, 0, "")]


def test_tokens_by_rank_are_the_library_s():
    with open(A, "rb") as f:
        data = f.read()
    ranked, library = crosstok.ByteLevel(data, public_tokenizers.PATTERN), crosstok.ByteLevel(data)
    r = random.Random(2)
    texts = ["".join(chr(c) for c in (r.randrange(1, 0x110000) if r.random() < 0.3 else r.randrange(0x20, 0x600) for _ in range(60)) if not 0xD800 <= c < 0xE000) for _ in range(400)]
    texts += [t or "" for _, t in TEXTS] + ["a" * 5000, " " * 5000, "don't I'LL we've  x's\n\n \t9999999 \u00b2\u00bd\u0661"]
    assert ranked.ranked is not None and library.ranked is None and ranked.encode(texts) == library.encode(texts)
    other = json.loads(data)
    other["model"]["merges"].reverse()
    assert crosstok.ByteLevel(json.dumps(other).encode(), public_tokenizers.PATTERN).ranked is None


def test_crosstok_takes_a_very_long_text(spark, docs):
    text = prose(3, 40_000)
    got = crosstok.align(docs((1, text)), A, B).first()
    (x, y), ends = plain_tokens([text])[0], lambda t: {e for *_, e in spans(t)}
    assert (got.n_a, got.n_b, got.n_groups, got.n_links) == (len(x), len(y), len(ends(x) & ends(y)), len(ends(x) | ends(y)))


def test_count_shards_copied_by_spark_are_the_mapped_ones(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    r = random.Random(1)
    rows = [(r.randrange(40) << 32 | r.randrange(300), r.randrange(1, 9)) for _ in range(5000)] + [(7 << 32 | 7, 1)] * 4000
    want = collections.Counter()
    for k, n in rows:
        want[k] += n
    frame = spark.createDataFrame(rows, "key long, n long").repartition(5)
    keys = np.array(sorted(want), np.int64)
    for mounted in (True, False):
        shards = crosstok.count_shards(frame, 40, mounted)
        assert len(shards.names) > 1 and shards.counts(keys).tolist() == [want[k] for k in keys.tolist()]
        assert shards.best.tolist() == [max(n for k, n in want.items() if k >> 32 == b) for b in range(40)]
        assert shards.counts(keys[5:6]).tolist() == [want[int(keys[5])]]


# 12


def plain_trie(rows, rebuild=True):
    turns = collections.defaultdict(list)
    digest = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    for c, n, r, t in rows:
        if c is not None:
            turns[c].append(((n is not None, n or 0), digest(r or "", t or ""), r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:] if rebuild else v
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    out = []
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    r = random.Random(5)
    rows = [(c, n, r.choice(["user", "assistant"]), r.choice(["a", "b", "éè"])) for c in range(-12, 130) for n in range(r.randrange(9))]
    rows += [(500, n, "user", f"t{n}") for n in range(150)] + [(501, n, "user", f"t{n}") for n in range(90)]  # one long path
    rows += [(600 + k, 0, "user", "hello") for k in range(400)]  # one very common conversation
    rows += [(30, None, None, None), (31, 3, "user", None), (31, 3, "user", None), (31, 3, "x", "tie"), (None, 0, "user", "of none"), (2000, 1, "", "user"), (2001, 1, "user", ""), (7001, None, "", "")]
    r.shuffle(rows)
    return rows


def test_trie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = conversations()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"slot": F.lit("x"), "k1": F.lit(1), "m": F.lit("x")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_trie(spark, str(tmp_path)).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == plain_trie(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = conversations()
    nodes, whole = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = nodes.join(trie.end_digests(trie.end_texts(whole)), trie.KEY, "left").na.fill(hashlib.sha256(b"").hexdigest()).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == plain_trie(rows, rebuild=False)
    empty, ends = trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.count() == 0 and ends.count() == 0


def test_roll_up_takes_as_many_rounds_as_the_depth_has_digits(spark, monkeypatch):
    made = []
    real = trie.materialize
    monkeypatch.setattr(trie, "materialize", lambda df, label, *a: made.append(label) or real(df, label, *a))
    path = spark.createDataFrame([(k, k - 1 if k else None, 1) for k in range(300)], "k int, p int, v long")
    got = {r.k: r.v for r in trie.roll_up(path, ["v"], ["k"], ["p"]).collect()}
    assert got == {k: 300 - k for k in range(300)} and made.count("rollup") == 1 + 9


# 13


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    runs = collections.defaultdict(list)
    for k in range(len(words) - 7):
        runs[tuple(words[k : k + 8])].append(k)
    covered = {k + j for at in runs.values() if len(at) > 1 for k in at for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), n < 20 or 100 * len(covered) > 30 * n


M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_margin(text, weights, intercept):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [mix((sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & M64) for w in words]
    of_words = [mix(h ^ 1) >> 46 for h in hashes]
    of_words += [mix((a * 0xD6E8FEB86659FD93 + (0x5851F42D4C957F2D if b == a else b) + 2) & M64) >> 46 for a, b in zip(hashes, hashes[1:])]
    of_chars = []
    for n in (2, 3, 4):
        for k in range(len(text) - n + 1):
            h = n
            for c in text[k : k + n]:
                h = (h * 0xD6E8FEB86659FD93 + ord(c)) & M64
            of_chars.append(mix(h) >> 46)
    return intercept + sum(50 * sum(weights[g] for g in grams) / len(grams) for grams in (of_words, of_chars) if grams)


RULED = [*EDGE, (40, "a b c d e f g h " * 3 + prose(1, 40)), (41, "x y\nx y\n \nx y \n\n|#*$ <>&%"), (42, prose(8, 30) + "\n" + prose(8, 30)), (43, "   x\x85y\x1cz"), (44, "same " * 40), (45, prose(2, 7)), (46, prose(2, 8) + " . " + prose(2, 8))]


def test_quality_rules_count_as_plain_loops(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 300)
    r = np.random.default_rng(2)
    model = qualityrules.Model(r.standard_normal(1 << 18), 0.3, 0.7, -0.1)
    got = qualityrules.quality_rules(docs(*RULED), model).collect()
    want = [(i, *plain_counts(t)) for i, t in RULED]
    assert sorted((tuple(x)[:7] for x in got), key=key) == sorted(want, key=key)
    chance = {x.doc_id: x.probability for x in got}
    weights = model.weights.astype(np.float32).astype(float)
    for i, t in RULED:
        assert i is None or abs(chance[i] - 1 / (1 + math.exp(-max(-35, min(35, 0.7 * plain_margin(t or "", weights, 0.3) - 0.1))))) < 1e-6
    assert all(x.kept == (not x.base_failed and x.probability >= 0.5) for x in got)
    assert qualityrules.quality_rules(docs(), model).count() == 0


def test_features_are_what_margins_sum_up(spark):
    weights = np.random.default_rng(3).standard_normal(1 << 18)
    texts = [t or "" for _, t in RULED]
    index_value = [qualityrules.Texts([t]).features(0) for t in texts]
    assert np.allclose(qualityrules.Texts(texts).margins(weights, 0.5), [0.5 + v @ weights[i] for i, v in index_value], atol=1e-8)


def test_quality_rules_learn_and_leave_held_out_labels_alone(spark, docs):
    good = [(k, prose(k, 60)) for k in range(120)]
    bad = [(k, " ".join(f"{w}!! |" for w in prose(k, 60).split())) for k in range(120, 200)]
    frame = docs(*good, *bad, (900, None))
    labels = spark.createDataFrame([(k, int(k < 120), "x") for k, _ in good + bad] + [(900, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    held = {k for k, _ in good + bad if zlib.crc32(str(k).encode()) % 5 == 0}
    model = qualityrules.fit_without_held_out(frame, labels)
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(*held), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = qualityrules.fit_without_held_out(frame, flipped)
    assert np.allclose(model.weights, again.weights) and abs(model.offset - again.offset) < 1e-9
    kept = {r.doc_id: r.kept for r in qualityrules.quality_rules(frame, model).collect()}
    assert all(kept[k] == (k < 120) for k in held) and not kept[900]


def test_quality_rules_without_labels_of_both_kinds(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    frame = docs((1, prose(1, 30)), (2, prose(2, 30)))
    assert [r.kept for r in qualityrules.quality_rules(frame, qualityrules.fit(frame, labels)).collect()] == [True, True]
    nothing = qualityrules.fit(frame, labels.limit(0))
    assert {r.probability for r in qualityrules.quality_rules(frame, nothing).collect()} == {0.5}
