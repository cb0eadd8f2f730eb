"""What is shuffled: no more than is needed, and no key's rows in one task where they can be told apart before."""

from pyspark.sql import functions as F

from cairn.operators import recall
from cairn.plans import textual


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_of_each_is_cut_before_the_shuffle_and_spreads_null_keys(spark):
    rows = spark.range(0, 4_000, 1, 4).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("k"), (-F.col("id")).alias("o"))
    got = recall.first_of_each(rows, ["k"], ["o"])
    assert {(r.id, r.k) for r in got.collect()} == {(k, None) for k in range(1, 4_000, 2)} | {(3_996, 0), (3_998, 2), (3_994, 1)}
    assert "WindowGroupLimit" in plan(got)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 1_600  # of 2,000 rows with null keys


def test_grams_of_neighbours_are_made_behind_the_shuffle(spark, tmp_path):
    spark.createDataFrame([(k, f"text {k}", "en", f"src{k % 2}", 6) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = textual.c3_gram_word_jaccard(spark, str(tmp_path))
    assert got.count() == 38
    lines = plan(got).split("\n")
    made = [k for k, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert made and max(made) < min(k for k, line in enumerate(lines) if "Exchange" in line)
