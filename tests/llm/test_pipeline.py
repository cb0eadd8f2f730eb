"""The pipeline's stages, one after the other, on the smallest tables."""

import collections

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cairn.llm import bpe, mixing, quality, queries

from .plain import PlainFTRL, held_out, plain_components, plain_copies, plain_features, plain_lines, plain_targets, shingle_set


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    docs, out = queries.table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages(spark, folder, stages):
    assert [n for n, _ in stages] == ["quality", "lines", "near", "mix", "bpe"]
    before = queries.table(spark, folder, "documents")
    for _, docs in stages[:-1]:
        assert docs.columns == before.columns
    after = {n: [tuple(r) for r in d.collect()] for n, d in stages}
    assert set(after["quality"]) <= {tuple(r) for r in before.collect()}
    assert {r[0] for r in after["lines"]} <= {r[0] for r in after["quality"]}
    assert all(r[4] == len(r[1]) for r in after["lines"])
    assert set(after["near"]) <= set(after["lines"]) and set(after["mix"]) <= set(after["near"])
    assert max(collections.Counter(r[0] for r in after["mix"]).values()) <= 2
    assert len(after["bpe"]) == len(after["mix"])


def test_labels_of_kept_documents(spark, folder, stages):
    labels = {r.doc_id: r.quality for r in queries.table(spark, folder, "labels").collect()}
    kept = {r.doc_id for r in stages[0][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_quality_stage_is_the_plain_one(spark, folder, stages):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, folder, "documents").collect()]
    frame = queries.table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    told = [(x.h, x.doc_id, x.quality) for x in frame.select("doc_id", "quality", F.xxhash64("doc_id", "quality").alias("h")).collect() if not held_out(x.doc_id)]
    texts, model = {i: t for i, t in sorted(rows, key=lambda x: x[1] or "", reverse=True)}, PlainFTRL()
    learned = [(plain_features(texts[i] or ""), q) for _, i, q in sorted(told) if i in texts]
    for _ in range(quality.ROUNDS):
        for x, q in learned:
            model.learn(x, q)
    scores = [(i, t, model.score(plain_features(t or ""))) for i, t in rows]
    got = collections.Counter((r.doc_id, r.text) for r in stages[0][1].collect())
    wrong = [s for i, t, s in scores if (s >= 0.3) != ((i, t) in got)]
    assert all(abs(s - 0.3) < 1e-3 for s in wrong), wrong
    assert 0 < sum(got.values()) < len(rows)


def test_lines_and_near_stages_are_the_plain_ones(stages):
    by = dict(stages)
    rows = [(r.doc_id, r.text) for r in by["quality"].collect()]
    hashes = {x.text: x.h for x in by["quality"].select("text", F.xxhash64("text").alias("h")).collect()}
    want, kept = plain_lines(rows, hashes), []
    for i, t in rows:
        out = t if t is None or not want[i, t] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i, t])
        if t is None or not want[i, t] or out.strip(" \t\n\x0b\x0c\r"):
            kept.append((i, out))
    assert collections.Counter((r.doc_id, r.text) for r in by["lines"].collect()) == collections.Counter(kept)
    _, roots = plain_components(kept, 80)
    first = {}
    for root, (i, t) in sorted(zip(roots, kept), key=lambda x: x[1][0]):
        first.setdefault(root if shingle_set(t) else (i, t), (i, t))
    assert sorted((r.doc_id, r.text) for r in by["near"].collect()) == sorted(first.values())


def test_mix_and_bpe_stages_are_the_plain_ones(stages):
    by = dict(stages)
    rows = by["near"].select("doc_id", "text", "source", F.xxhash64("text").alias("th"), mixing.word_count(F.col("text")).alias("size"))
    rows = rows.withColumns({"slice": F.pmod(F.xxhash64("doc_id", "size"), F.lit(mixing.SLICES)), "offset": F.pmod(F.xxhash64("source", F.lit(1)), F.lit(mixing.STEPS)) / mixing.STEPS})
    rows = rows.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double")) * mixing.CLASSES_PER_DOUBLING)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = collections.Counter()
    for source, target in plain_targets(sizes, queries.MIX_WEIGHTS).items():
        own = sorted((r for r in rows if r.source == source), key=lambda r: (r["class"], r.slice, r.size, r.doc_id, r.th))
        for r, n in zip(own, plain_copies(own, target, sizes[source], own[0].offset)):
            want[r.doc_id, r.text] += n
    mixed = collections.Counter((r.doc_id, r.text) for r in by["mix"].collect())
    assert mixed == +want
    ranks = bpe.Codec(bpe.rank_bytes(public_tokenizers.path(queries.RANKS)), public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = collections.Counter()
    for (i, t), n in mixed.items():
        ids = plain.encode_ordinary(t or "")
        tokens[i, len(ids), tuple(ids)] += n
    assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in by["bpe"].collect()) == tokens


def test_entry_has_every_query():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names


def test_no_rows(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        queries.table(spark, folder, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
