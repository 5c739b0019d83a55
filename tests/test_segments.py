"""Segmented windows equal the plain ones, with null keys and one dominant key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtide.operators import sampling
from flowtide.operators.segments import even_cuts, last_known, numbered, ranked, running_sums

ROWS = [(i, "hot" if i % 3 else (None if i % 2 else f"k{i % 5}"), (i * 37) % 101, (i % 4) or None) for i in range(600)]
SCHEMA = "id int, key string, t int, v int"


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_ranked(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("t", "id")))
    cut = ranked(df, ["key"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")])
    assert by_id(cut, "rn") == by_id(plain, "rn")


def test_even_cuts(spark):
    """A third of the rows crowd into one narrow stretch; nulls and ties are kept."""
    rows = [(i, "k", 50 + i % 7 if i % 3 else i * 13, 1) for i in range(600)] + [(900 + i, "k", None, 1) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("t", "id")))
    for fan, size in ((64, 40), (8, 10), (8, 1), (1024, 100_000)):
        cut = even_cuts(df, "t", "id", size, fan)
        assert by_id(ranked(cut, ["key"], F.col("__cut"), [F.col("t"), F.col("id")]), "rn") == by_id(plain, "rn")
    assert even_cuts(df.where("id < 0"), "t").count() == 0
    assert even_cuts(df.where("t IS NULL"), "t", "id", 2).count() == 9


def test_cuts_bound_the_largest_part(spark):
    """90 % of the rows have one key, half of its values are one tick, and scores crowd at 0 and 1."""
    df = spark.range(40_000).select(
        F.col("id"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 2 == 0, 7.0).when(F.col("id") % 3 == 0, 1e-6 * (F.col("id") % 1000)).otherwise(1 - 1e-6 * (F.col("id") % 999)).alias("t"))
    for fan, size in ((1024, 500), (16, 500)):
        cut = even_cuts(df, "t", "id", size, fan)
        parts = [r["count"] for r in cut.groupBy("__cut").count().collect()]
        assert max(parts) <= 3 * size and len(parts) >= 40_000 / size / 2
    got = ranked(cut, ["key"], F.col("__cut"), [F.col("t"), F.col("id")])
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("t", "id")))
    assert by_id(got, "rn") == by_id(plain, "rn")


def test_numbered(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plain = df.withColumn("n", F.row_number().over(Window.orderBy("t", "id")))
    for fan, size in ((1024, 250_000), (8, 5)):
        assert by_id(numbered(df, "t", [F.col("t"), F.col("id")], "id", size, fan), "n") == by_id(plain, "n")
    assert numbered(df.where("id < 0"), "t", [F.col("t")]).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    upto = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("total", F.coalesce(F.sum("v").over(upto), F.lit(0)))
    cut = running_sums(df.withColumn("v", F.coalesce("v", F.lit(0))), ["key"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], {"total": "v"})
    assert by_id(cut, "total") == by_id(plain, "total")


def test_last_known(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    upto = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("seen", F.last("v", ignorenulls=True).over(upto))
    cut = last_known(df, ["key"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], "v", "seen")
    assert by_id(cut, "seen") == by_id(plain, "seen")


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, "big" if i % 4 else f"c{i % 3}") for i in range(500)], "id int, label string")
    sizes = sampling.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in {r["label"] for r in sizes}:
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_exact_samples(spark):
    df = spark.range(1000)
    assert sampling.exact_sample(df, "id", n=37).count() == 37
    assert sampling.exact_sample(df, "id", fraction=0.1).count() == 100
    assert sampling.exact_sample(df, "id", n=5000).count() == 1000
    assert sampling.exact_sample(df, "id", n=0).count() == 0
    train, test = sampling.exact_split(df, "id", 0.2)
    assert (train.count(), test.count()) == (800, 200)
    assert train.join(test, "id").count() == 0
