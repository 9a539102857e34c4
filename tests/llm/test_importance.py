"""Importance resampling: against a plain computation, with frequent and rare words, longer n-grams, awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from brookmill.llm.importance import counted, ranked, resampled
from brookmill.llm.query_importance import op13_importance
from brookmill.sources.tables import table

DOCS = "doc_id long, text string"


def plain(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    """By row: features, weight, score, rank."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    each = [(i, words(t)) for i, t in docs]
    s, t = Counter(b for _, w in each for b in grams(w)), Counter(b for x in target for b in grams(words(x)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, w in each:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in grams(w))
        out.append([i, len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def rows(got):
    return sorted(((r.doc_id, r.imp_features, r.imp_weight, r.imp_score, r.imp_rank) for r in got.collect()), key=repr)


@pytest.mark.parametrize("longest,most_bytes", [(1, 48_000_000), (1, 30_000), (1, 0), (3, 48_000_000), (3, 30_000)])
def test_against_a_plain_computation(spark, longest, most_bytes):
    """Whatever part of words and tuples is looked up in tables sent to all tasks."""
    rng = random.Random(longest)
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["The", "é", "ab"]) + str(int(rng.expovariate(0.02))) for _ in range(n))
    docs = [(k, some(rng.randrange(60))) for k in range(300)] + [(None, some(30)), (400, None), (401, ""), (402, "#!"), (5, "twice " * 30), (5, "twice " * 30), (None, "none " * 25)]
    target = [some(30) for _ in range(40)] + [None, "only here"]
    got = ranked(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, longest=longest, buckets=500, most_bytes=most_bytes)
    assert rows(got) == sorted(plain(docs, target, longest, 500, percent=30), key=repr)


@pytest.mark.parametrize("bits", [63, 2])
def test_dictionary(spark, bits):
    """Also where most words share a hash: each has an id of its own, with its counts."""
    docs, target = spark.createDataFrame([(1, "b a B c a b"), (2, "é"), (3, None)], DOCS), spark.createDataFrame([("a d",)], "text string")
    table, odd = counted(docs, target, 2, bits)
    rows = table.collect()
    assert len({r.tuple for r in rows}) == len(rows) and bool(odd) == (bits == 2)
    word = {bytes(r.tuple): r.word for r in rows if r.word is not None}
    text = lambda key: " ".join(word[bytes(key[i : i + 8])] for i in range(0, len(key), 8))
    assert {text(bytes(r.tuple)): (r.s, r.t) for r in rows} == {
        "a": (2, 1), "b": (3, 0), "c": (1, 0), "d": (0, 1), "é": (1, 0), "b a": (1, 0), "a b": (2, 0), "b c": (1, 0), "c a": (1, 0), "a d": (0, 1)}


def test_words_that_share_a_hash(spark):
    docs = [(k, f"w{k % 5} w{k % 7} w{k % 11} " * 9) for k in range(80)]
    target = spark.createDataFrame([("w3 w4 w10",)], "text string")
    assert rows(ranked(spark.createDataFrame(docs, DOCS), target, longest=2, bits=3, most_bytes=1500)) == sorted(plain(docs, ["w3 w4 w10"], 2), key=repr)


def test_drawn_rows_keep_their_columns(spark):
    docs = [(k, f"word{k % 7} " * (10 + k % 30), "x", k) for k in range(200)]
    df = spark.createDataFrame(docs, f"{DOCS}, imp_rank string, row int")
    target = spark.createDataFrame([("word3 word4",)], "text string")
    drawn = resampled(df, target)
    assert drawn.columns == df.columns
    want = {i for (i, _, _, _, rank) in plain([(d[0], d[1]) for d in docs], ["word3 word4"]) if rank}
    assert {r.doc_id for r in drawn.collect()} == want and all(r.imp_rank == "x" and r.text == docs[r.row][1] for r in drawn.collect())


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a " * 30)], DOCS), spark.createDataFrame([], DOCS)
    assert ranked(none, docs).collect() == [] and ranked(none, none).collect() == []
    assert rows(ranked(docs, none)) == sorted(plain([(1, "a " * 30)], []), key=repr)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    target = [r.text for r in table(spark, folder, "benchmark").collect()]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in op13_importance(spark, folder).collect()), key=repr)
    assert got == sorted(plain(docs, target), key=repr) and sum(r[4] is not None for r in got) > 10
