"""Packed id matrices: round trip, bins of a plain best fit, positions and segments."""

import random
from collections import Counter

import numpy as np

from brookmill.llm.query_sequences import op4_sequences
from brookmill.llm.sequences import CAPACITY, END_ID, best_fit_decreasing, matrices, restored, sequences, write
from brookmill.llm.tokens import byte_ids
from brookmill.sources.tables import table


def plain_best_fit(lengths, capacity):
    room, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in range(len(room)) if room[b] >= lengths[i]]
        b = min(fits, key=lambda b: room[b]) if fits else len(room)
        if b == len(room):
            room.append(capacity)
            bins.append([])
        room[b] -= lengths[i]
        bins[b].append(i)
    return room


def test_best_fit_decreasing():
    rng = random.Random(1)
    for capacity, n in [(1, 5), (10, 60), (100, 400), (4096, 300)]:
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        packed = best_fit_decreasing(lengths, capacity)
        assert sorted(i for b in packed for i in b) == list(range(n))
        rooms = [capacity - sum(lengths[i] for i in b) for b in packed]
        assert min(rooms) >= 0 and sorted(rooms) == sorted(plain_best_fit(lengths, capacity))


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc é日\n<|endoftext|>", k=rng.randint(0, 300))) for _ in range(400)] + [None, "", "long text " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(5)
    write(sequences(docs, capacity=128, group_bytes=20_000), f"{tmp_path}/packed")
    packed = spark.read.parquet(f"{tmp_path}/packed")
    assert {r.doc_id: r.text for r in restored(packed).collect()} == {i: t or "" for i, t in enumerate(texts)}
    rows = packed.collect()
    ids, positions = matrices(rows, 128)
    assert ids.shape == positions.shape == (len(rows), 128)
    seen = Counter()
    for r, own, place in zip(rows, ids, positions):
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and np.all(own[r.n_tokens :] == END_ID)
        assert np.flatnonzero(place == 0).tolist() == r.resets
        for k, (d, p, s) in enumerate(zip(r.doc_ids, r.pieces, r.starts)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert s == 128 * p and place[a:b].tolist() == list(range(b - a)) and a in r.resets
            whole = np.append(byte_ids()(texts[d] or ""), END_ID)
            assert own[a:b].tolist() == whole[s : s + b - a].tolist()
            seen[d] += b - a
    assert seen == {i: len(byte_ids()(t or "")) + 1 for i, t in enumerate(texts)}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    packed = op4_sequences(spark, folder)
    assert {r.doc_id: r.text for r in restored(packed).collect()} == texts
    rows = packed.collect()
    total = sum(len(byte_ids()(t)) + 1 for t in texts.values())
    assert sum(r.n_tokens for r in rows) == total and len(rows) <= -(-total // CAPACITY) + 1
    assert all(len(r.ids) == len(r.positions) == 2 * CAPACITY and r.cu_seqlens[-1] == r.n_tokens for r in rows)


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, "d")]
    got = sequences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(d for r in got for d in r.doc_ids) == Counter({1: 2, None: 2})
    assert sequences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_are_dealt_to_all_groups(spark):
    rows = [(i, f"text number {i}") for i in range(400)] + [(None, "")] * 1000 + [(7, "again and again")] * 1000
    got = sequences(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), capacity=64, group_bytes=3000).collect()
    for doc_id, n in ((None, 1000), (7, 1001)):
        groups = Counter()
        for r in got:
            groups[r.sequence_id >> 32] += r.doc_ids.count(doc_id)
        assert sum(groups.values()) == n and max(groups.values()) < 250
