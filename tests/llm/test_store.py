"""Written tables, checked joins and columns set apart."""

import os

from pyspark.sql import functions as F

from brookmill.llm.store import discard, join_checked, passing, set_apart, written
from brookmill.session import shared_folder


def test_written_and_discarded(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = written(df, "test")
    assert [tuple(r) for r in kept.orderBy("id").collect()] == [tuple(r) for r in kept.orderBy("id").collect()]
    assert kept._written_path.startswith(shared_folder(spark))
    path = kept._written_path.removeprefix("file:")
    assert os.path.exists(path)
    discard(kept)
    assert not os.path.exists(path)
    assert written(spark.range(0), "test").count() == 0


def test_join_gives_the_same_by_either_way(spark):
    big, small = spark.range(100).withColumn("k", F.col("id") % 7), written(spark.range(5).withColumnRenamed("id", "k"), "test")
    for how in ("inner", "left", "left_semi", "left_anti"):
        ways = [sorted(map(tuple, join_checked(big, small, ["k"], how, most_bytes=most).collect())) for most in (0, 1000)]
        assert ways[0] == ways[1]
    hinted = lambda most: "strategy=broadcast" in join_checked(big, small, ["k"], "inner", most_bytes=most)._jdf.queryExecution().logical().toString()
    assert hinted(1000) and not hinted(100)


def test_columns_set_apart_come_back(spark):
    docs = spark.createDataFrame([(1, "t", 2, 3)], ["doc_id", "text", "a.b", "carried_0"])
    there, back = set_apart(docs, ("doc_id", "text"))
    assert there.columns == ["doc_id", "text", "carried_2", "carried_3"]
    assert back(there.withColumn("own", F.lit(1))).collect() == docs.collect() and back(there).columns == docs.columns


def test_tables_of_a_scope_are_removed(spark):
    there = lambda t: os.path.exists(t._written_path.removeprefix("file:"))
    with passing() as outer:
        with passing() as inner:
            a, b = written(spark.range(3), "test"), written(spark.range(4), "test")
            inner.keep(b)
        assert not there(a) and there(b)
        c = written(spark.range(5), "test")
        outer.keep(c)
    assert not there(b) and there(c) and c.count() == 5
    try:
        with passing():
            d = written(spark.range(3), "test")
            raise KeyError
    except KeyError:
        pass
    assert not there(d)
    discard(c)
