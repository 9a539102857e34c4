"""Mixing: against a plain water-filling loop, and on awkward rows."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brookmill.llm.mixing import mixed, told_apart, with_copies
from brookmill.llm.store import written

SCHEMA = "doc_id long, text string, source string, mix_size string"


def by_loop(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 9}" if i % 5 else None, "x") for i in range(9000)]
    rows += [(None, "a b", "tiny", None), (5, None, "void", None), (6, "", "void", None)]
    got = with_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = by_loop(sizes)
    for r in got:
        assert r.mix_target == pytest.approx(want[r.source])
        assert 0 <= r.mix_copies <= 3
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert abs(r.mix_copies - rate) < 1 + 1e-9
        taken[r.source] += r.mix_copies * int(r.mix_size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.1 * want[s], 3)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mix_emits_copies_and_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", "x" if i % 3 else "y", "kept") for i in range(300)], SCHEMA)
    out = mixed(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.mix_copies for r in with_copies(docs).collect()}
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
        assert r.text == "a b c" and r.mix_size == "kept"
    assert {k: v for k, v in want.items() if v} == dict(counts)


def test_empty_table(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rows", [
    pytest.param(lambda i: (None, f"text number {i}"), id="no ids"),
    pytest.param(lambda i: (i if i % 2 else 7, "a b c d" if i % 4 == 0 else f"text number {i}"), id="one id on half the rows"),
    pytest.param(lambda i: (None, None) if i % 5 == 0 else (1, "all the same"), id="equal rows"),
])
def test_targets_are_met_where_ids_repeat(spark, rows):
    made = [(*rows(i), f"s{i % 5}", str(i % 2)) for i in range(5000)]
    docs = spark.createDataFrame(made, SCHEMA).repartition(6)
    got = with_copies(docs).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.mix_copies * r.mix_size
        target[r.source] = r.mix_target
    assert len(got) == len(made)
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.1 * target[s]
    again = with_copies(docs.repartition(3)).collect()
    count = lambda rows: sorted(((r.doc_id, r.text, r.source, r.mix_copies) for r in rows), key=str)
    assert count(again) == count(got)


def test_repeated_rows_with_columns_of_any_kind(spark):
    docs = spark.createDataFrame([(1, "a b", "x", {"k": i % 2}, i % 3, "own", [i]) for i in range(60)], "doc_id long, text string, source string, m map<string,int>, scan_piece int, mix_row string, `a.b` array<int>")
    out = mixed(docs)
    assert out.columns == docs.columns and {r.mix_row for r in out.collect()} == {"own"}
    assert abs(out.count() - 60) <= 20 and with_copies(docs).count() == 60


def test_equal_rows_are_numbered_over_many_pieces(spark):
    docs = spark.createDataFrame([(1, "same", "s")] * 3000 + [(i, "x", None) for i in range(50)], "doc_id long, text string, source string").repartition(4)
    keyed = docs.withColumn("mix_row", F.xxhash64("doc_id", "text", "source"))
    again = written(keyed.groupBy("mix_row").count().where("count > 1").select("mix_row"), "again")
    got = told_apart(keyed, again)
    assert sorted(r.mix_number for r in got.where("source = 's'").collect()) == list(range(1, 3001))
    assert {r.mix_number for r in got.where("source is null").collect()} == {1}
