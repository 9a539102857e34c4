"""Near duplicates: classes against brute force, signatures against exact similarity."""

import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from brookmill.llm.components import connected
from brookmill.llm.minhash import near_classes, one_of_each, probability_jaccard, shingle_set, signature, weights_of
from brookmill.llm.query_minhash import op1_minhash
from brookmill.session import shared_folder
from brookmill.sources.tables import table


def shingles(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    if not a or not b:
        return False
    if max(*a.values(), *b.values()) == 1:  # sets of equal weights have the plain similarity
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys()) >= 0.8
    x, y = ({k: 1 + np.log(v) for k, v in s.items()} for s in (a, b))
    weighed = sum(1 / sum(max(x.get(k, 0) / x[d], y.get(k, 0) / y[d]) for k in x.keys() | y.keys()) for d in x.keys() & y.keys())
    return weighed >= 0.8


def classes_by_hand(rows, number=False):
    """Least id, or number, of each row's component; rows with equal shingles are one node."""
    nodes = {}
    for i, t in rows:
        nodes.setdefault(frozenset(shingles(t or "").items()), []).append(i)
    keys = list(nodes)
    sets = [Counter(dict(k)) for k in keys]
    parent = list(range(len(keys)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    tried = set()
    for ks in holders.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    if alike(sets[a], sets[b]):
                        parent[find(b)] = find(a)
    if number:
        return {key: find(k) for k, key in enumerate(keys)}
    least = {}
    for k, key in enumerate(keys):
        ids = [i for i in nodes[key] if i is not None]
        if ids:
            least[find(k)] = min(least.get(find(k), min(ids)), min(ids))
    return {key: least.get(find(k)) for k, key in enumerate(keys)}


def classes_by_hand_key(want, text):
    return want[frozenset(shingles(text or "").items())]


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    fresh = lambda n: [word() for _ in range(n)]
    passage, texts = fresh(60), []
    for _ in range(60):
        texts.append(fresh(rng.randint(1, 200)))
    for _ in range(60):  # a passage shared by texts that are not near copies
        texts.append(fresh(20) + passage + fresh(20))
    base = fresh(300)
    for _ in range(80):  # a large group around one text
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(300)] = word()
        texts.append(copy)
    chain = fresh(200)
    for _ in range(12):  # a chain of small steps
        chain = chain[6:] + fresh(6)
        texts.append(chain)
    line = fresh(8)
    texts += [line * 40, line * 35, line * 40 + fresh(2), ["same"] * 500, ["same"] * 900]
    for times in (2, 5, 30, 1000):  # one line comes often in one of two texts, both or none
        own, often = fresh(80), fresh(6)
        texts += [own + often, own + often * times, own + often * (times + 1), own[3:] + often * times]
    texts += [t for t in texts[:20] for _ in range(3)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block,most,levels", [(512, 16, 3), (4, 1, 2), (3, 2, 0)])
def test_classes_match_brute_force(spark, block, most, levels):
    texts = corpus(random.Random(7))
    rows = list(enumerate(texts)) + [(7000, None), (7001, ""), (7002, " \n"), (None, "lone words here"), (5, texts[5]), (5, texts[90]), (None, texts[8]), *[(None, f"no id {k}") for k in (1, 1, 2, 2, 2)]]
    docs = spark.createDataFrame([(a, b, b"x") for a, b in rows], "doc_id long, text string, near_key binary").repartition(5)
    got = near_classes(docs, block=block, most_blocks=most, levels=levels).collect()
    want = classes_by_hand(rows)
    expected = Counter((i, want[frozenset(shingles(t or "").items())]) for i, t in rows)
    assert Counter((r.doc_id, r.class_id) for r in got) == expected
    nodes = defaultdict(set)
    for i, t in rows:
        nodes[classes_by_hand_key(want, t)].add(frozenset(shingles(t or "").items()))
    for r in got:
        if r.doc_id in range(100, 200):
            assert r.class_links >= len(nodes[r.class_id]) - 1
    if levels:
        return
    kept = one_of_each(docs, block=block, most_blocks=most, levels=levels)
    assert kept.columns == docs.columns
    component = classes_by_hand(rows, number=True)
    of = lambda i, t: component[frozenset(shingles(t or "").items())]
    left = [(of(r.doc_id, r.text), r.doc_id) for r in kept.collect()]
    best = {}
    for i, t in rows:
        best[of(i, t)] = min(best.get(of(i, t), (True, 0)), (i is None, i or 0))
    assert sorted(left, key=repr) == sorted(((c, None if none else i) for c, (none, i) in best.items()), key=repr)


def test_size_of_blocks_does_not_matter(spark):
    """Few bands and a low threshold: many pairs share one band only, in buckets that hold most strangers."""
    rng = random.Random(11)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=4)) for _ in range(n)]
    common = fresh(40)
    texts = [common + fresh(rng.randint(10, 60)) for _ in range(150)]
    texts += [t[: rng.randint(40, len(t))] + fresh(rng.randint(1, 30)) for t in texts[:100]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    given = {"threshold": 0.6, "registers": 12, "rows": 2}
    found = [sorted((r.doc_id, r.class_id) for r in near_classes(docs, block=block, most_blocks=most, levels=levels, **given).collect()) for block, most, levels in ((512, 16, 3), (2, 1, 2))]
    assert found[0] == found[1] and 20 < len({c for _, c in found[0]}) < 240


def test_ids_do_not_matter(spark):
    """Null ids cost no more than ids of their own, and give the same classes."""
    texts = [" ".join(t.split()) for t in corpus(random.Random(8))]
    sizes, took = [], []
    for ids in (range(len(texts)), [None] * len(texts)):
        began = time.perf_counter()
        got = near_classes(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
        took.append(time.perf_counter() - began)
        sizes.append(sorted(r.class_size for r in got))
        assert len({r.class_key for r in got}) < len(texts)
    assert sizes[0] == sizes[1] and took[1] < 2 * took[0] + 10


def test_long_texts(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200_000)]
    changed = list(words)
    for _ in range(2000):
        changed[rng.randrange(len(words))] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[100_000:])), (4, "word " * 300_000), (5, "x" * 2_000_000)]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_tables_are_removed(spark):
    folder = shared_folder(spark).removeprefix("file:")
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = near_classes(docs)
    assert {n.split("-")[1] for n in set(os.listdir(folder)) - there} == {"signed", "named"} and got.count() == 200
    there = set(os.listdir(folder))
    assert 0 < one_of_each(docs).count() < 200
    assert {n.split("-")[1] for n in set(os.listdir(folder)) - there} == {"dropped", "again"}


def test_signature_estimates_probability_jaccard():
    rng = random.Random(2)
    words = [str(i) for i in range(4000)]
    for size in (3, 40, 900):
        a = rng.sample(words, size) * 2 + rng.choices(words, k=size)
        b = a[: int(len(a) * 0.9)]
        (x, n), (y, m) = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        exact = probability_jaccard(x, weights_of(n), y, weights_of(m))
        estimate = np.mean(signature(x, weights_of(n), 2048) == signature(y, weights_of(m), 2048))
        assert abs(exact - estimate) < 0.04


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 400)] + [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(300)] + [(1, 1)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    assert set(got) == set(near)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[start] == min(seen)


def test_query_and_empty_table(spark):
    folder = "/root/testdata/sf0.001"
    got = op1_minhash(spark, folder).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    want = classes_by_hand(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: want[frozenset(shingles(t).items())] for i, t in rows}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(empty).collect() == [] and one_of_each(empty).collect() == []
