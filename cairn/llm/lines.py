"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its lower-cased words. Tokens are put in order of rarity, rarest first; two sets
reach a Jaccard similarity only if they share a token among the first few of each (prefix filter), their sizes are close
(length filter), and what stands after the shared token can still make up the overlap (positional filter). A parity
bitmap of each set, whose XOR has no more bits than the sets' symmetric difference has members, rules out most other pairs within the
join. The pairs that are left are verified on whole sets. Both joins are semi-joins: they stop at a line's first
partner and write it once, so that a group of similar lines never gives its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, small
from .fingerprint import GAP

#: Hash buckets in which tokens are counted for their rarity: the whole of what the counts take, however large the vocabulary.
BUCKETS = 1 << 17
#: Sets up to this size have bitmaps of 64 bits, others of 128.
SMALL = 40


def rarity(docs: DataFrame, text_col: str = "text") -> Column:
    """A number for each hash bucket: 4 log2 of the number of words of all texts that fall into it, in whole steps, below 128.

    Words are cut at single spaces and newlines here, which is cheaper; what else they are cut at does not change the order much, and no order makes
    the join miss a pair. The numbers are written as text that the optimizer turns into an array once.
    """
    spark = docs.sparkSession
    words = docs.select(F.explode(F.split(F.replace(F.lower(F.col(text_col)), F.lit("\n"), F.lit(" ")), " ")).alias("w")).select(F.hash("w").bitwiseAND(BUCKETS - 1).cast("long").alias("bucket"))
    counts = words.groupBy("bucket").count().unionByName(spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(1).cast("long").alias("count")))
    steps = counts.groupBy("bucket").agg(F.least(F.floor(4 * F.log2(F.sum("count"))), F.lit(127)).cast("int").alias("step"))
    found = steps.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "step"))), lambda x: x["step"]).alias("steps")).first()["steps"]  # BUCKETS of them
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")


def bare(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def split_words(line: Column) -> Column:
    """The lower-cased words of a bare line, which has no line feed. Splitting at single spaces is cheaper, and does where no other gap occurs."""
    other = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    return F.when(other, F.split(F.lower(line), GAP)).otherwise(F.split(F.lower(line), " "))


def token_set(line: Column, steps: Column) -> Column:
    """The distinct tokens of a bare line with a word as sorted longs: seven bits of rarity, then 56 bits of hash. Rare ones come first.

    What stands below a lambda is interpreted, what stands above it is compiled: so words are named by one lambda, before they are made distinct.
    """
    name = lambda w: F.shiftleft(F.get(steps, F.hash(w).bitwiseAND(BUCKETS - 1)), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8))
    return F.sort_array(F.array_distinct(F.transform(split_words(line), name)))


def parity(tokens: Column) -> Column:
    """Two longs of 64 bits, each of which tells whether an odd number of tokens falls on it. Sets of SMALL tokens at most use the first only."""
    one, none, half = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit(1 << 26).cast("bigint")
    turn = lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int")))
    of = lambda some: F.aggregate(some, none, turn)
    few = F.size(tokens) <= SMALL
    low = F.when(few, of(tokens)).otherwise(of(F.filter(tokens, lambda t: t.bitwiseAND(half) == 0)))
    return F.struct(low.alias("a"), F.when(few, none).otherwise(of(F.filter(tokens, lambda t: t.bitwiseAND(half) != 0))).alias("b"))


def prefix_size(size: Column, percent: int) -> Column:
    """How many of a set's rarest tokens another set with the similarity must share one of."""
    return (size - F.floor((size * percent + 99) / 100) + 1).cast("int")


def index_size(size: Column, percent: int) -> Column:
    """How many of the smaller set's rarest tokens one of the larger set's first few must be among."""
    return (size - F.ceil(2 * percent * size / F.lit(float(100 + percent)) - 1e-9) + 1).cast("int")


def _shape(name: str) -> tuple[Column, Column, Column]:
    """Of a posting its set's size, the token's place, and whether that is in the indexed part: packed into one long, as postings are what is moved most."""
    packed = F.col(f"{name}.shape")
    return F.shiftright(packed, 32), F.shiftright(packed, 1).bitwiseAND(0x7FFFFFFF), packed.bitwiseAND(1) == 1


def _may_match(percent: int) -> Column:
    """Prefix, length, bitmap and positional filters on postings l and r of one token: no pair at the similarity fails them for all its tokens.

    Bitmaps of 64 and of 128 bits are compared as 64 bits: halves fold into one by XOR.
    """
    (a, i, li), (b, j, ri) = _shape("l"), _shape("r")
    length = (a * 100 >= b * percent) & (b * 100 >= a * percent)
    la, lb, ra, rb = F.col("l.a"), F.col("l.b"), F.col("r.a"), F.col("r.b")
    both = F.bit_count(la.bitwiseXOR(ra)) + F.bit_count(lb.bitwiseXOR(rb))
    folded = F.bit_count(la.bitwiseXOR(lb).bitwiseXOR(ra).bitwiseXOR(rb))
    apart = F.when((a <= SMALL) == (b <= SMALL), both).otherwise(folded)
    bitmap = apart * (100 + percent) <= (a + b) * (100 - percent)
    prefix = F.when(a <= b, li).otherwise(ri)
    most = F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1)
    position = most * (100 + percent) >= (a + b) * percent
    return length & prefix & bitmap & position


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """sets (first, size, a, b, prefix) once for each token of the prefix: (token, first, shape, a, b)."""
    rows = sets.select("first", "size", "a", "b", F.posexplode("prefix").alias("at", "token"))
    indexed = (F.col("at") < index_size(F.col("size"), percent)).cast("bigint")
    shape = F.shiftleft(F.col("size").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("bigint"), 1)).bitwiseOR(indexed)
    return rows.select("token", "first", shape.alias("shape"), "a", "b")


def _verified(l: DataFrame, r: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The places of postings l that have an earlier partner among postings r of one token, by whole sets."""
    whole = lambda df: df.join(tokens, "first").withColumn("n", F.size("tokens"))
    l = whole(l).alias("l")
    r = whole(r.join(l.select("token").distinct(), "token", "left_semi")).alias("r")
    similar = F.size(F.array_intersect("l.tokens", "r.tokens")) * (100 + percent) >= (F.col("l.n") + F.col("r.n")) * percent
    on = (F.col("l.token") == F.col("r.token")) & (F.col("r.first") < F.col("l.first")) & _may_match(percent) & similar
    return l.join(r, on, "left_semi").select("first").distinct()


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, line): the bare lines with a word; th names the text, no counts all lines from 0. A null text has no line."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))
    return rows.withColumn("line", bare(F.col("line"))).where("line <> ''")


def _key(tokens: Column) -> Column:
    """A 128-bit name of a set."""
    return F.struct(F.xxhash64("tokens").alias("x"), F.xxhash64(F.lit(7), "tokens").alias("y"))


def line_decisions(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, no, removed) for each line with a word, of each row of docs; th is xxhash64 of the row's text.

    Lines stand in the order of id, an integer, nulls first, th and no. A line is removed if an earlier line, itself removed or not, has a set with
    100 * intersection >= percent * union; equal sets are one such case. Lines without a word always stay and aren't listed. Rows
    equal in id and text have equal decisions, as of one row.
    """
    steps = rarity(docs, text_col)
    lines = split_lines(docs, id_col, text_col).withColumn("tokens", token_set(F.col("line"), steps))
    size = F.size("tokens")
    short = F.transform(F.slice("tokens", F.lit(1), prefix_size(size, percent)), lambda t: t.bitwiseAND(0x7FFFFFFF).cast("int"))
    lines = materialize(lines.select("id", "th", "no", _key(F.col("tokens")).alias("key"), size.alias("size"), parity(F.col("tokens")).alias("bits"), short.alias("prefix")), "lines")
    place = _place(lines)
    lines_at = lines.withColumn("place", place)
    firsts = lines_at.groupBy("key").agg(F.min("place").alias("first"))
    sets = lines_at.join(firsts, "key").where("place = first").select("first", "size", "bits.a", "bits.b", "prefix")
    all_postings = postings(sets, percent)
    on = (F.col("l.token") == F.col("r.token")) & _may_match(percent)
    met = all_postings.alias("l").join(all_postings.alias("r"), on & (F.col("l.first") != F.col("r.first")), "left_semi")
    met = materialize(met, "met")  # postings with a partner, earlier or later
    n = met.count()
    earlier = on & (F.col("r.first") < F.col("l.first"))
    later = materialize(met.alias("l").join(met.alias("r"), earlier, "left_semi"), "later", n)
    partners = materialize(met.alias("r").join(later.alias("l"), earlier, "left_semi"), "partners", n)
    release(met)
    chosen = later.select("first").unionByName(partners.select("first")).distinct()
    at = materialize(lines_at.join(small(chosen), F.col("place") == F.col("first"), "left_semi").select("id", "th", "no", "place").distinct(), "at")
    where = at.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("no", "place")).alias("_lines"))  # lines of one text
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = texts.join(small(where), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    again = texts.select(F.explode("_lines").alias("x"), F.split("text", "\n").alias("all")).select("x.place", token_set(bare(F.get("all", F.col("x.no"))), steps).alias("tokens"))
    tokens = materialize(again.groupBy(F.col("place").alias("first")).agg(F.any_value("tokens").alias("tokens")), "tokens", n)
    release(at)
    # A later set is first compared at its rarest such token, where its partner mostly is; what is then left, at all its others.
    rank = F.row_number().over(Window.partitionBy("first").orderBy(F.shiftright("shape", 1).bitwiseAND(0x7FFFFFFF)))
    gone = materialize(_verified(later.withColumn("_n", rank).where("_n = 1").drop("_n"), partners, tokens, percent), "gone", n)
    rest = later.join(gone, "first", "left_anti")
    removed = materialize(gone.unionByName(_verified(rest, partners, tokens, percent)), "removed", n)
    release(later, partners, tokens, gone)
    of_set = firsts.join(removed.withColumn("gone", F.lit(True)), "first", "left").select("key", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    return lines_at.select("id", "th", "no", "key", "place").join(of_set, "key").select("id", "th", "no", (F.col("gone") | (F.col("place") != F.col("first"))).alias("removed"))


def _place(lines: DataFrame) -> Column:
    """The order of lines by id, nulls first, text hash and number: as one long where ids are of one text each and all fit, else as a struct."""
    b = lines.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("no").alias("no")).first()
    fits = b["low"] is None or (b["low"] >= 0 and b["high"] < 1 << 40 and b["no"] < 1 << 22)
    if fits and lines.select("id", "th").distinct().count() == lines.select("id").distinct().count():
        return F.coalesce(F.col("id").cast("long"), F.lit(-1)) * (1 << 22) + F.col("no")
    return F.struct("id", "th", "no")


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, th, n_removed, removed): sorted numbers of the lines to go, a row for each id and text with any. See line_decisions."""
    gone = line_decisions(docs, percent, id_col, text_col).where("removed").select("id", "th", "no").distinct()
    return gone.groupBy("id", "th").agg(F.count("*").alias("n_removed"), F.sort_array(F.collect_list("no")).alias("removed")).withColumnRenamed("id", id_col)


def line_report(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_removed, removed): a row per row of docs; numbers of the lines that line_decisions removes, from 0.

    A null text has no line, an empty one has one without a word. Ids may be null or repeat. Other columns are ignored. No rows give no rows.
    """
    gone = removed_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), percent, "id", "text").withColumnRenamed("id", "_id")
    count = (F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"))) + 1).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_h"), F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(count).alias("n_lines"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("th")), "left")
    return joined.select(F.col("id").alias(id_col), "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def remove_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's removed lines taken out; a row all of whose lines with words are removed goes.

    Rows without a word in any line stay as they are, null and empty texts among them. All other columns of docs stay as they
    are, whatever their names. Rows equal in id and text fare alike.
    """
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = removed_lines(whole, percent, "id", "text").select(F.col("id").alias("g_id"), F.col("th").alias("g_th"), "removed")
    joined = whole.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.xxhash64("text") == F.col("g_th")), "left")
    # The kept lines are the runs between removed ones, a slice for each removed line, so that the work is linear in lines. The text is split once, for a lambda.
    edges = lambda lines: F.arrays_zip(F.concat(F.array(F.lit(-1)), "removed").alias("a"), F.concat("removed", F.array(F.size(lines))).alias("b"))
    runs = lambda lines: F.flatten(F.transform(edges(lines), lambda e: F.slice(lines, e["a"] + 2, e["b"] - e["a"] - 1)))
    kept = F.get(F.transform(F.array(F.split("text", "\n")), runs), F.lit(0))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("text", text).where(F.col("removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
