"""Numbers and window functions over pieces, against Spark's own windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.operators.scans import first, in_pieces, lag, lead, moving_sum, ntile, numbered, ordered, percent_rank, rank, row_number, running_sum


def rows(n=700):
    """Nine of ten rows are of one key; there are null keys, ties, and null values."""
    rng = random.Random(1)
    return [(i, "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None, "c"]), rng.choice([None, *range(30)]), rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("pieces", [1, 5, 60, 400])
def test_windows_of_a_hot_key(spark, pieces):
    """Also with pieces of a row or two, so that lag, lead and sums reach over several."""
    df = spark.createDataFrame(rows(), "id int, k string, t int, v int")
    scans = {"b": lag("v"), "b3": lag("id", 3, -1), "a2": lead("id", 2, -5), "f": first("v"), "s": running_sum(F.col("v")), "m": moving_sum(F.col("v"), 2, 1), "n": row_number(), "q": ntile(4), "q9": ntile(900)}
    got = ordered(ordered(df, ["k"], ["t", "id"], scans, pieces), ["k"], ["t"], {"r": rank(), "p": percent_rank()}, pieces)
    w, u = W.partitionBy("k").orderBy("t", "id"), W.partitionBy("k").orderBy("t")
    want = df.select(
        "*", F.lag("v").over(w), F.lag("id", 3, -1).over(w), F.lead("id", 2, -5).over(w), F.first("v").over(w), F.sum("v").over(w), F.sum("v").over(w.rowsBetween(-2, 1)),
        F.row_number().over(w), F.ntile(4).over(w), F.ntile(900).over(w), F.rank().over(u), F.percent_rank().over(u))
    assert got.columns == [*df.columns, *scans, "r", "p"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_several_keys_and_no_rows(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3 or None, i) for i in range(100)], "id int, a int, b int, t int")
    got = ordered(df, ["a", "b"], ["t"], {"n": row_number(), "x": lag("id")}, 9)
    w = W.partitionBy("a", "b").orderBy("t")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.select("*", F.row_number().over(w), F.lag("id").over(w)).collect()), key=repr)
    assert ordered(df.where("false"), ["a", "b"], ["t"], {"n": row_number(), "x": lag("id"), "r": rank()}).collect() == []
    with pytest.raises(ValueError):
        ordered(df, ["a"], ["t"], {"b": row_number()})


def test_tasks_are_even(spark):
    """90 % of rows on one key: no piece holds more than about its share."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    sizes = [r["count"] for r in in_pieces(df, [F.col("k"), F.col("t")], 20).groupBy("scan_piece").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 40_000 / 20


def test_numbers(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(300)], "v int, w string")
    got = numbered(df, [F.desc("v")], "n", 7).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 301)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)
    assert numbered(df.where("v < 0"), [F.desc("v")], "n").collect() == []
