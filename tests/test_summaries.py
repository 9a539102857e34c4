"""Summaries within their errors, frequent values exactly, skylines, on uneven rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmill.operators import skyline as module
from brookmill.operators.skyline import skyline, undominated
from brookmill.operators.summaries import estimates, frequent_values, heavy_hitters, merged, summaries
from brookmill.plans import catalog
from brookmill.sources.tables import table


def test_sketches_by_day_merge_to_the_whole(spark, tmp_path):
    """Written by day, merged by kind: within 5 % of distinct values and 2 % of ranks, nine of ten rows on one kind."""
    df = spark.range(60_000).select(
        (F.col("id") % 30).alias("day"), F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("kind"),
        (F.xxhash64("id") % 8000).alias("user"), F.pmod(F.xxhash64(F.lit("v"), "id"), F.lit(1_000_000)).alias("v"))
    summaries(df, ["day", "kind"], "user", "v").write.parquet(f"{tmp_path}/daily")
    daily = spark.read.parquet(f"{tmp_path}/daily")
    got = {r.kind: r for r in estimates(merged(daily, ["kind"]), [0.1, 0.5, 0.9]).collect()}
    for kind in ("hot", "cold"):
        own = df.where(F.col("kind") == kind)
        values = np.sort(np.array([r.v for r in own.select("v").collect()]))
        assert got[kind].n == len(values)
        assert got[kind].distinct == pytest.approx(own.select("user").distinct().count(), rel=0.05)
        for share, x in zip([0.1, 0.5, 0.9], got[kind].quantiles):
            assert abs(np.searchsorted(values, x) / len(values) - share) < 0.02


@pytest.mark.parametrize("size", [1, 10, 100])
def test_heavy_hitters_within_their_error(spark, size):
    rng = random.Random(size)
    rows = [rng.choice(["hot", "hot", "warm", None, str(rng.randrange(3000)), str(int(rng.expovariate(0.1)))]) for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in rows], "x string").repartition(7)
    true = Counter(x for x in rows if x is not None)
    got = {r.value: r for r in heavy_hitters(df, F.col("x"), size).collect()}
    assert len(got) <= size
    assert all(r.least <= true[v] <= r.most and r.most - r.least <= true.total() / size for v, r in got.items())
    assert {v for v, n in true.items() if n > true.total() / size} <= set(got)
    exact = {r.value: r.n for r in frequent_values(df, F.col("x"), size).collect()}
    assert exact == {v: n for v, n in true.items() if n * size > true.total()}


def test_frequent_values_of_nothing(spark):
    none = spark.createDataFrame([], "x string")
    assert frequent_values(none, F.col("x"), 5).collect() == [] and heavy_hitters(none, F.col("x"), 5).collect() == []
    assert frequent_values(spark.createDataFrame([(None,)] * 9, "x string"), F.col("x"), 5).collect() == []


def plain(points):
    return [not any((q <= p).all() and (q < p).any() for q in points) for p in points]


def test_undominated(monkeypatch):
    monkeypatch.setattr(module, "STEP", 7)
    rng = np.random.default_rng(1)
    for d in (1, 2, 4):
        points = rng.integers(0, 6, (80, d)).astype(float)
        assert undominated(points).tolist() == plain(points)


@pytest.mark.parametrize("block", [4096, 10])
def test_skyline(spark, monkeypatch, block):
    """Also with many blocks, equal rows, nulls and NaN, and a third of rows that nothing dominates."""
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(2)
    rows = [(i, rng.randrange(50), float(rng.randrange(50)), rng.randrange(4)) for i in range(300)] + [(300 + i, i, float(2 * i), 9) for i in range(100)]
    rows += [(500, None, 1.0, 1), (501, 1, float("nan"), 1), (502, 99, 198.0, 9), (503, 99, 198.0, 9)]
    df = spark.createDataFrame(rows, "id int, a int, b double, c int").repartition(6)
    got = skyline(df, ["a"], ["b", "c"])
    assert got.columns == df.columns
    ok = [r for r in rows if r[1] is not None and r[2] == r[2]]
    want = [r for r, keep in zip(ok, plain(np.array([(a, -b, -c) for _, a, b, c in ok], float))) if keep]
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in want) and len(want) > 90
    assert skyline(df.where("false"), ["a"], ["b"]).collect() == []


def test_query_estimates(spark):
    folder = "/root/testdata/sf0.01"
    true = {r.event_type: r for r in table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.percentile("value", [0.47, 0.53]).alias("near")).collect()}
    got = catalog.QUERIES["event_summaries"](spark, folder).collect()
    assert len(got) == len(true)
    for r in got:
        t = true[r.event_type]
        assert r.n == t.n and r.users == pytest.approx(t.users, rel=0.05) and t.near[0] <= r.median <= t.near[1]
