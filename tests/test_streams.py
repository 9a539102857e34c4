"""Stateful streams over several batches: rows out of order, late rows, a key with most rows.

Spark takes a row as late by the watermark of the batch before, so what makes
others late comes two batches earlier here.
"""

import datetime as dt
import random
import threading
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from brookmill.session import setting
from brookmill.streaming.joins import interval_join
from brookmill.streaming.sessions import STORE, joined, merged, stream_sessions
from brookmill.streaming.windows import emitted, in_batches, without_repeats

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def batches(spark, tmp_path, schema, *parts):
    """A stream that takes one part after the other."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")


def sessions(spark, stream, gap, late):
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", STORE):
        got = emitted(stream_sessions(stream, "u", "ts", gap, late)).collect()
    return sorted((r.u, r.began, r.ended, r.n) for r in got)


def test_merged_spans():
    assert merged([(5, 9, 2), (0, 1, 1), (30, 30, 1), (10, 20, 3)], 4) == [(0, 20, 6), (30, 30, 1)]
    assert merged([], 4) == []


def test_rows_out_of_order_connect_sessions_and_late_rows_are_left_out(spark, tmp_path):
    first = [("a", at(0)), ("a", at(100)), ("b", at(50)), (None, at(1)), ("a", None)]
    second = [("a", at(50)), ("b", at(300))]  # connects the two of a, within the 200 seconds allowed
    third = [("a", at(5)), ("c", at(140)), ("b", at(1000))]  # 5 is later than 300 - 200 allows, 140 isn't
    fourth = [("b", at(2000))]
    stream = batches(spark, tmp_path, "u string, ts timestamp", first, second, [("z", at(299))], third, fourth)
    assert sessions(spark, stream, 60, "200 seconds") == [
        ("a", at(0), at(100), 3), ("b", at(50), at(50), 1), ("b", at(300), at(300), 1), ("b", at(1000), at(1000), 1), ("c", at(140), at(140), 1), ("z", at(299), at(299), 1)]


def test_sessions_of_a_hot_key_over_batches(spark):
    """Nine of ten rows are one key's; the stream emits each session once, with the rows of the batch result."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("ab"), at(rng.randrange(20_000))) for _ in range(4000)] + [("end", at(90_000))]
    got = sessions(spark, in_batches(spark.createDataFrame(rows, "u string, ts timestamp").repartition(6), "ts", 5), 15, "60 seconds")
    want = []
    for u in ("hot", "a", "b"):
        own = [(int((t - START).total_seconds()), int((t - START).total_seconds()), 1) for k, t in rows if k == u]
        want += [(u, at(a), at(b), n) for a, b, n in merged(own, 15)]
    assert got == sorted(want) and len(set(got)) == len(got)


def test_joined_spans_of_many_keys():
    """The same as merged() key by key."""
    rng = random.Random(3)
    for _ in range(50):
        rows = [(rng.choice("abc"), (low := rng.randrange(200)), low + rng.choice([0, 0, rng.randrange(40)]), rng.randrange(1, 4)) for _ in range(rng.randrange(40))]
        spans = pd.DataFrame(rows, columns=["k", "low", "high", "n"]).astype({c: "int64" for c in ("low", "high", "n")})
        got = joined(spans, "k", 5).itertuples(index=False, name=None)
        assert list(got) == [(k, *s) for k in "abc" for s in merged([r[1:] for r in rows if r[0] == k], 5)]
    assert joined(pd.DataFrame({"k": [float("nan")] * 2, "low": [0, 3], "high": [0, 3], "n": [1, 1]}), "k", 5)["n"].tolist() == [2]


class Timers(StreamingQueryListener):
    """How many timers the streams' batches set."""

    def __init__(self):
        self.set, self.ended = 0, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.set += sum(s.customMetrics.get("numRegisteredTimers", 0) for s in event.progress.stateOperators)

    def onQueryTerminated(self, event):
        self.ended.set()


def test_timers_do_not_grow_with_sessions(spark):
    """Twenty sessions of each of 200 keys in three batches: at most one timer a key and batch, not one a session."""
    rows = [(f"u{k}", at(1000 * s + k)) for k in range(200) for s in range(20)] + [("end", at(90_000))]
    timers = Timers()
    spark.streams.addListener(timers)
    try:
        got = sessions(spark, in_batches(spark.createDataFrame(rows, "u string, ts timestamp"), "ts", 3), 15, "60 seconds")
        assert timers.ended.wait(60)
    finally:
        spark.streams.removeListener(timers)
    assert got == sorted((u, t, t, 1) for u, t in rows if u != "end")
    assert 0 < timers.set <= 800


@pytest.mark.parametrize("parts", [1, 4])
def test_interval_join_of_two_streams(spark, parts):
    """Nine of ten rows are one user's; pairs and rows without one are each emitted once."""
    rng = random.Random(parts)
    user = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    left = [(i, user(), at(rng.randrange(30_000))) for i in range(400)] + [(400, "end", at(200_000)), (401, "hot", None)]
    right = [(i, user(), at(rng.randrange(30_000))) for i in range(300)] + [(300, "end", at(199_000)), (301, "hot", at(7)), (302, "hot", None)]
    a = in_batches(spark.createDataFrame(left, "id int, u string, ts timestamp"), "ts", parts)
    b = in_batches(spark.createDataFrame(right, "other int, u string, seen timestamp"), "seen", parts)
    got = emitted(interval_join(a, b, ["u"], "ts", "seen", 120, "30 seconds")).collect()
    want = Counter()
    for i, u, t in left:
        if u is not None and t is not None:
            near = [j for j, v, s in right if v == u and s is not None and dt.timedelta(0) <= t - s <= dt.timedelta(seconds=120)]
            for j in near or [None]:
                want[i, u, j] += 1
    del want[400, "end", None]  # the watermark has not passed it yet
    assert Counter((r.id, r.u, r.other) for r in got) == want


def test_a_late_partner_is_left_out(spark, tmp_path):
    (tmp_path / "l").mkdir(), (tmp_path / "r").mkdir()
    a = batches(spark, tmp_path / "l", "id int, u string, ts timestamp", [(1, "x", at(100)), (2, "y", at(100))], [(3, "x", at(5000))], [(6, "w", at(5001))], [(4, "x", at(9000))])
    b = batches(spark, tmp_path / "r", "other int, u string, seen timestamp", [(1, "y", at(90))], [(2, "z", at(5000))], [(5, "z", at(5001))], [(3, "x", at(95)), (4, "z", at(9000))])
    got = emitted(interval_join(a, b, ["u"], "ts", "seen", 60, "10 seconds")).collect()
    assert sorted((r.id, r.other or 0) for r in got) == [(1, 0), (2, 1), (3, 0), (6, 0)]


def test_no_key_is_emitted_twice_until_it_is_forgotten(spark, tmp_path):
    stream = batches(spark, tmp_path, "id int, ts timestamp", [(1, at(0)), (1, at(1)), (2, at(5))], [(1, at(9)), (3, at(20))], [(2, at(200))], [(4, at(201))], [(1, at(210)), (3, at(215)), (3, at(216))])
    got = emitted(without_repeats(stream, "ts", "50 seconds", ["id"]))
    assert Counter(r.id for r in got.collect()) == {1: 2, 2: 1, 3: 2, 4: 1}
    wide = emitted(without_repeats(batches(spark, tmp_path / "again", "id int, ts timestamp", [(1, at(0)), (2, at(5))], [(1, at(9)), (2, at(30))]), "ts", "50 seconds", ["id"]))
    assert sorted((r.id, r.ts) for r in wide.collect()) == [(1, at(0)), (2, at(5))]


def test_in_batches(spark):
    df = spark.createDataFrame([(i, at(i)) for i in range(100)], "id int, ts timestamp")
    got = emitted(in_batches(df, "ts", 4)).groupBy("batch").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("batch").collect()
    assert [(r.a, r.b) for r in got] == [(0, 24), (25, 49), (50, 74), (75, 99)]
    assert emitted(in_batches(df.where("false"), "ts", 2)).collect() == []
