"""Names of a vocabulary of any size, found in texts by joins of word runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shuffled, stored
from .ordered import first_after, reached

#: A word: letters and digits of any script, in lower case.
WORD = r"[\p{L}\p{N}]+"
#: Names are cut into pieces of so many words; a text's runs of up to so many words are looked up.
PIECE = 4
#: Pieces of a vocabulary up to this number are broadcast.
FEW_PIECES = 200_000
#: Word places of a slot in which the next match is looked for.
SLOT = 1_024


def words(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0))


def pieces(names: DataFrame) -> DataFrame:
    """(piece, name, n, k, of): the pieces of the names (name), each name as its words joined by a space, once; k counts the words before a piece.

    The last piece of a name of PIECE words or more is whole too, and may overlap the one before: a rest of one word would stand in most texts. Names without words have none.
    """
    cut = names.select(words(F.col("name")).alias("w")).where("size(w) > 0").select(F.array_join("w", " ").alias("name"), "w", F.size("w").alias("n")).dropDuplicates(["name"])
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE)), lambda k: F.least(k, F.greatest(F.col("n") - PIECE, F.lit(0)))))
    return cut.select("w", "name", "n", F.size(starts).alias("of"), F.explode(starts).alias("k")).select(F.array_join(F.slice("w", F.col("k") + 1, PIECE), " ").alias("piece"), "name", "n", "k", "of")


def all_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, at, n, name): every place, counted in words from 0, at which a text (id, value) holds a name (name), overlaps included. ids are unique.

    A text's runs are joined to the pieces; a longer name is where all its pieces stand one after another. Nothing is searched name by name, and a text is carried
    by none of its rows.
    """
    known = stored(pieces(names), "pieces")
    few = known.limit(FEW_PIECES + 1).count() <= FEW_PIECES
    runs = texts.select("id", words(F.col("value")).alias("w"))
    runs = runs.select("id", F.explode(F.transform("w", lambda x, i: F.struct(i.alias("at"), F.slice("w", i + 1, PIECE).alias("g")))).alias("x")).select("id", "x.at", "x.g")
    keys = F.array(*[F.when(F.size("g") >= k, F.array_join(F.slice("g", 1, k), " ")) for k in range(1, PIECE + 1)])
    hits = runs.select("id", "at", F.explode(keys).alias("piece")).where("piece IS NOT NULL").join(F.broadcast(known) if few else known, "piece").select("id", (F.col("at") - F.col("k")).alias("at"), "n", "name", "of")
    return hits.groupBy("id", "at", "n", "name", "of").agg(F.count("*").alias("got")).where("got = of").select("id", "at", "n", "name")


def leftmost_longest(matches: DataFrame) -> DataFrame:
    """Of matches (id, at, n, name) those that a reader keeps who takes the longest at the first place, then goes on behind it.

    A match that begins behind the ends of all before it is kept in any case; from there each kept match points to the first one behind its own end. Pointers are doubled, so
    that a long chain of overlaps takes few rounds.
    """
    found = stored(matches.groupBy("id", "at").agg(F.max(F.struct("n", "name")).alias("m")).select("id", "at", "m.*", F.struct("id", "at").alias("node")), "matches")
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    heads = found.select("node", (F.col("at") >= F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0))).alias("start"))
    probes = found.select(F.col("id").alias("doc"), F.col("node").alias("pid"), (F.col("at") + F.col("n")).alias("at"), F.lit(-1).alias("tie"))
    nexts = first_after(probes, found.select(F.col("id").alias("doc"), F.lit(0).alias("id"), "at"), ["doc"], SLOT)
    nexts = nexts.select(F.col("pid").alias("node"), F.when(F.col("next").isNotNull(), F.struct(F.col("pid.id").alias("id"), F.col("next.at").alias("at"))).alias("next"))
    kept = reached(heads.join(shuffled(nexts), "node").select(F.col("node").alias("id"), "next", "start"))
    return found.join(shuffled(kept.select(F.col("id").alias("node"))), "node", "left_semi").select("id", "at", "n", "name")


def find_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, at, n, name): the names (name) that texts (id, value) hold, without overlaps, leftmost first and then longest; at and n count words, in whatever case and with whatever between them.

    Null and empty texts hold none; names that are null or have no word are found nowhere, and names of the same words are one. Other columns are left out.
    """
    return leftmost_longest(all_matches(texts, names))


def link_names(texts: DataFrame, names: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that texts (id, value) name: new ones (name), not among the known (name), and edges (fact_id, name), once each."""
    edges = stored(find_names(texts, names).select(F.col("id").alias("fact_id"), "name").distinct(), "edges")
    told = known.select(F.array_join(words(F.col("name")), " ").alias("name"))
    return edges.select("name").distinct().join(told, "name", "left_anti"), edges
