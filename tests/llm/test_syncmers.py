"""Fingerprints: anchors against a plain search, rows against a plain loop, likeness of edits."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brookmill.llm.query_syncmers import op7_syncmers
from brookmill.llm.syncmers import K, S, _heaviest_chain, _run_hashes, anchors, fingerprint, fingerprints, in_order, likeness
from brookmill.llm.textcode import code_points
from brookmill.sources.tables import table


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghilmnorstué", k=rng.randint(1, 9))) for _ in range(n))


def test_anchors_are_closed_syncmers():
    rng = random.Random(1)
    for text in [prose(rng, 300), "a" * 500, prose(rng, 7), "ab" * 100]:
        points = code_points(text)
        small = _run_hashes(points.astype(np.uint64), S).tolist()
        want = []
        for i in range(len(text) - K + 1):
            inside = small[i : i + K - S + 1]
            if min(inside) in (inside[0], inside[-1]):
                want.append(i)
        place, code = anchors(points)
        assert place.tolist() == (want or [0])
        runs = {}
        for p, c in zip(place.tolist(), code.tolist()):
            assert runs.setdefault(text[p : p + K], c) == c  # context-free
        assert len(set(runs.values())) >= 0.99 * len(runs)


def test_parts_do_not_matter(monkeypatch):
    import brookmill.llm.syncmers as module

    points = code_points(prose(random.Random(2), 3000))
    whole = anchors(points)
    monkeypatch.setattr(module, "PART", 777)
    cut = anchors(points)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_likeness():
    rng = random.Random(3)
    a, b = prose(rng, 800), prose(rng, 800)
    f = fingerprint
    assert likeness(f(a), f(a)) == 1.0 and likeness(f(a), f(b)) < 0.05
    assert 0.35 < likeness(f(a), f(a[: len(a) // 2] + b[: len(a) // 2])) < 0.65
    moved = b[:1000] + a
    assert likeness(f(a), f(moved)) > 0.75 and likeness(f(a), f(moved)) == likeness(f(moved), f(a))
    assert likeness(f(""), f("")) == 1.0 and likeness(f(""), f("x")) == 0.0
    words = a.split()
    for i in range(0, len(words), 100):
        words[i] = "changed"
    assert likeness(f(a), f(" ".join(words))) > 0.7


def test_edits_of_one_density_count_alike_at_every_length():
    rng = random.Random(5)
    found = []
    for n in (800, 3000, 8000, 20_000):
        words = prose(rng, n).split()
        changed = [w for i in range(0, n, 100) for w in [*words[i : i + 50], "".join(rng.choices("opqrxyz", k=12)), *words[i + 50 : i + 100]]]
        found.append(likeness(fingerprint(" ".join(words)), fingerprint(" ".join(changed))))
    assert min(found) > 0.85 and max(found) - min(found) < 0.05


def test_likeness_falls_with_the_share_that_changed():
    """By at most some five times that share, from 200 to 50,000 words; strangers stay apart."""
    rng = random.Random(9)
    for n in (200, 2000, 20_000, 50_000):
        words = prose(rng, n).split()
        for share in (0.005, 0.01, 0.02, 0.05):
            changed = list(words)
            for i in rng.sample(range(n), max(1, int(share * n))):
                changed[i] = words[i] + " " + "".join(rng.choices("opqrxyz", k=11))
            assert likeness(fingerprint(" ".join(words)), fingerprint(" ".join(changed))) > 1 - 5 * share - 0.02
        assert likeness(fingerprint(" ".join(words)), fingerprint(prose(rng, n))) < 0.05


def test_places_count():
    """Moved text counts on one side only: halves swapped, passages shuffled, words shuffled; a passage moved to the end."""
    rng = random.Random(11)
    for n in (2000, 5000, 20_000):
        words = prose(rng, n).split()
        f = fingerprint(" ".join(words))
        like = lambda changed: likeness(f, fingerprint(" ".join(changed)))
        assert 0.45 < like(words[n // 2 :] + words[: n // 2]) < 0.55
        blocks = [words[i : i + 20] for i in range(0, n, 20)]
        rng.shuffle(blocks)
        assert like([w for b in blocks for w in b]) < 0.2
        assert like(rng.sample(words, n)) < 0.02
        assert 0.85 < like(words[: n // 2] + words[n // 2 + n // 10 :] + words[n // 2 : n // 2 + n // 10]) < 0.95


def test_repeated_passages_without_their_first_or_last_copy():
    rng = random.Random(12)
    lines = [prose(rng, 30) for _ in range(3)]
    text = lines * 40
    for changed in (text[1:], text[:-1], ["x y z"] + text[1:]):
        assert likeness(fingerprint("\n".join(text)), fingerprint("\n".join(changed))) > 0.95


def test_heaviest_chain():
    rng = random.Random(13)
    for _ in range(200):
        n = rng.randint(0, 9)
        place, weight = rng.sample(range(50), n), [rng.randint(1, 9) for _ in range(n)]
        best = 0
        for mask in range(1 << n):
            some = [k for k in range(n) if mask >> k & 1]
            if all(place[x] < place[y] for x, y in zip(some, some[1:])):
                best = max(best, sum(weight[k] for k in some))
        assert _heaviest_chain(place, weight) == best


def test_short_texts(spark):
    rng = random.Random(6)
    texts = [prose(rng, 60)[:n] for n in range(20, 151) for _ in range(3)]
    got = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    near = sorted(r.near_edited for r in got)
    assert len(near) == len(texts) and near[0] > 0 and near[len(near) // 10] > 0.3 and near[-1] < 0.75
    assert sorted(r.near_next for r in got)[len(got) // 2] < 0.05


def test_rows_match_a_plain_loop(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 150)) for _ in range(300)]
    rows = [(5 * i - 700, t) for i, t in enumerate(texts)] + [(40, "x"), (40, "x"), (41, None), (42, ""), (43, "long " * 40000), (None, "no id"), (40, texts[0])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(6)
    got = fingerprints(docs, part_bytes=10_000).collect()
    hashed = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint(t), fingerprint(new), likeness(fingerprint(t), fingerprint(new)), likeness(fingerprint(t), fingerprint(after))] += 1
    assert Counter(tuple(r) for r in got) == want


def test_rows_of_one_id_are_spread(spark):
    """Nine of ten rows have one id, half of these are equal; null ids besides. Parts stay small and no row is lost."""
    rng = random.Random(8)
    rows = [(5 if i % 10 else i, "again " * 20 if i % 2 else prose(rng, 20)) for i in range(3000)] + [(None, "none")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = [r["count"] for r in in_order(docs, 10_000).where("role = 0").groupBy("part").count().collect()]
    assert len(sizes) > 25 and sum(sizes) == len(rows) and max(sizes) < 600
    assert in_order(docs, 10_000).where("role = 1").count() == len(sizes)
    got = fingerprints(docs, part_bytes=10_000).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, fingerprint(t)) for i, t in rows)
    equal = [r.near_next for r in got if r.fingerprint == fingerprint("again " * 20) and r.doc_id == 5]
    assert sum(x < 1 for x in equal) == 1  # each but the last is followed by its like


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    ids = sorted(texts)
    got = {r.doc_id: r for r in op7_syncmers(spark, folder).collect()}
    assert sorted(got) == ids
    for i, after in zip(ids, ids[1:] + ids[:1]):
        r, t, half = got[i], texts[i], len(texts[i]) // 2
        new = t[: len(t) - half] + texts[after][:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(t), fingerprint(new))
        assert (r.near_edited, r.near_next) == (likeness(fingerprint(t), fingerprint(new)), likeness(fingerprint(t), fingerprint(texts[after])))


def test_small_tables(spark):
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (only,) = fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
