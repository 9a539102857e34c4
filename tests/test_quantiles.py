"""Quantiles, row patterns and overlaps, against plain computations."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmill.operators.joins import overlap_join
from brookmill.operators.patterns import matches, runs
from brookmill.operators.quantiles import _narrowed, quantiles


@pytest.mark.parametrize("buckets", [2, 16, 1024])
def test_quantiles_of_a_hot_group(spark, buckets):
    """Nine of ten rows are one group's, with ties, nulls, negative and very large values; a group of one, of equal values, of nulls."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.choice([None, 5, 5, rng.randrange(-1000, 1000), rng.randrange(10**12)])) for _ in range(800)]
    rows += [("one", 7), ("same", 3), ("same", 3), ("same", 3), ("void", None), ("wide", 2**63 - 1), ("wide", -(2**63)), ("wide", 0)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", shares, buckets).collect()
    want = {(k, s): float(np.quantile(np.array([v for j, v in rows if j == k and v is not None], float), s)) for k in {k for k, _ in rows} - {"void", "wide"} for s in shares}
    found = {(r.k, r.share): r.quantile for r in got}
    assert {k: v for k, v in found.items() if k[0] != "wide"} == pytest.approx(want)
    assert [found["wide", s] for s in (0.0, 0.5, 1.0)] == [-(2.0**63), 0.0, 2.0**63] and len(found) == len(got) == len(want) + len(shares)


def test_quantiles_of_several_keys_and_no_rows(spark):
    df = spark.createDataFrame([(i % 2, i % 3, i) for i in range(60)], "a int, b int, v int")
    got = {(r.a, r.b): r.quantile for r in quantiles(df, ["a", "b"], "v", [0.5]).collect()}
    assert got == {(r.a, r.b): r.m for r in df.groupBy("a", "b").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert quantiles(df.where("false"), ["a"], "v", [0.5]).collect() == []


def test_a_round_narrows_the_range(spark):
    rows = spark.createDataFrame([(1, v) for v in range(1000)], "q_0 int, v long")
    state = spark.createDataFrame([(1, 0.5, 499.5, 499, 0, 999, 499)], "q_0 int, share double, at double, rank long, low long, high long, left long")
    (r,) = _narrowed(rows, state, ["q_0"], 10).collect()
    assert (r.low, r.high, r.left) == (400, 499, 99)


def by_regex(rows, steps):
    """Groups as strings of kinds, searched by a pattern; the kinds are letters."""
    out = []
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        text = "".join(kind or "-" for _, kind in own)
        inner = "".join(c + ("+" if many else "") for c, many in steps[1:-1])
        head = f"(?<!{steps[0][0]}){steps[0][0]}+" if steps[0][1] else steps[0][0]
        tail = steps[-1][0] + (f"+(?!{steps[-1][0]})" if steps[-1][1] else "")
        # at every place, as stretches may share a row
        for i in range(len(text)):
            m = re.compile(head + inner + tail).match(text, i)
            if m:
                out.append((k, own[m.start()][0], own[m.end() - 1][0], m.end() - m.start()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pieces", [1, 7, 150])
@pytest.mark.parametrize("steps", [[("v", True), ("c", True), ("p", False)], [("v", False), ("c", False), ("p", True)], [("c", True), ("v", True)], [("v", True), ("c", False), ("v", True)]])
def test_patterns_of_a_hot_group(spark, pieces, steps):
    rng = random.Random(len(steps) + pieces)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), t, rng.choice(["v", "v", "c", "c", "p", "x", None])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, kind string")
    got = sorted(((r.k, r["first"].t, r["last"].t, r.n) for r in matches(df, ["k"], ["t"], "kind", steps, pieces).collect()), key=repr)
    assert got == by_regex(rows, steps) and got


def test_runs_and_wrong_steps(spark):
    df = spark.createDataFrame([("k", t, kind) for t, kind in enumerate(["a", "a", None, None, "b", "a"])], "k string, t int, kind string")
    got = sorted((r.run_first.t, r.run_last.t, r.run_kind, r.run_n) for r in runs(df, ["k"], ["t"], "kind", 3).collect())
    assert got == [(0, 1, "a", 2), (2, 3, None, 2), (4, 4, "b", 1), (5, 5, "a", 1)]
    for steps in ([("a", True)], [("a", True), ("a", False)]):
        with pytest.raises(ValueError):
            matches(df, ["k"], ["t"], "kind", steps)


def test_overlaps_of_ranges_of_any_width(spark):
    """Widths from nothing to 10^6 and beyond, negative places, one hot key; each pair once."""
    rng = random.Random(4)
    wide = lambda: int(10 ** rng.uniform(0, 6.5)) - 1

    def ranges(n, prefix):
        out = []
        for i in range(n):
            low = rng.randrange(-2_000_000, 2_000_000)
            out.append((f"{prefix}{i}", rng.choice(["hot", "hot", "hot", "a", None]), low, low + rng.choice([wide(), wide(), 0])))
        return out + [(f"{prefix}x", "hot", 5, 4), (f"{prefix}y", "hot", None, 4), (f"{prefix}z", "hot", -(2**62), 2**61), (f"{prefix}t", "hot", 8, 8), (f"{prefix}u", "hot", 0, 2**20 - 1), (f"{prefix}v", "hot", 2**20, 2**20)]

    left, right = ranges(150, "l"), ranges(120, "r")
    a, b = spark.createDataFrame(left, "l string, k string, lo long, hi long"), spark.createDataFrame(right, "r string, k string, since long, until long")
    got = sorted((r.l, r.r) for r in overlap_join(a, b, ["k"], ("lo", "hi"), ("since", "until")).collect())
    ok = lambda r: r[1] is not None and r[2] is not None and r[2] <= r[3]
    want = sorted((x[0], y[0]) for x in left for y in right if ok(x) and ok(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and len(want) > 300
    assert overlap_join(a.where("false"), b, ["k"], ("lo", "hi"), ("since", "until")).collect() == []
    assert overlap_join(a, b.where("false"), ["k"], ("lo", "hi"), ("since", "until")).collect() == []


def test_overlap_join_broadcasts_no_copies(spark):
    """Tables that look small to Spark become many rows, one for each level; these don't go through the driver."""
    a = spark.range(300).selectExpr("id AS l", "id % 3 AS k", "id * 10 AS lo", "id * 10 + id % 7 AS hi")
    b = spark.range(200).selectExpr("id AS r", "id % 3 AS k", "id * 15 AS since", "id * 15 + shiftleft(1L, int(id % 12)) AS until")
    pairs = overlap_join(a, b, ["k"], ("lo", "hi"), ("since", "until"))
    want = a.join(b, "k").where("lo <= until AND since <= hi")
    assert sorted(map(tuple, pairs.select("l", "r").collect())) == sorted(map(tuple, want.select("l", "r").collect()))
    assert "SortMergeJoin" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan
