"""Decontamination: hits against a plain search, removal of spans and documents, awkward tables. (The query's SQL is in test_sql.)"""

import hashlib
import random
import re

import pytest

from brookmill.llm import decontamination as module
from brookmill.llm.decontamination import found, hits, without_documents, without_spans

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(text, items, width=10):
    w, places, ids = words(text), set(), set()
    for item, other in items:
        o = words(other)
        size = min(width, len(o))
        for j in range(len(o) - size + 1 if o else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == o[j : j + size]:
                    places |= set(range(i, i + size))
                    ids.add(item or "")
    return len(w), places, ids


def tables(seed=1):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["Ab", "cd", "É", "7", "x-y", "#", "zz", "Qß"]) + str(rng.randrange(40)) for _ in range(n)]
    items = [(f"i{k}", " ".join(some(rng.choice([1, 3, 9, 10, 11, 30])))) for k in range(40)]
    items += [("copy", items[5][1]), ("shout", items[6][1].upper()), ("none", None), ("void", "#!"), (None, "only this item here"), ("10", items[7][1]), ("9", items[7][1])]
    docs = []
    for k in range(60):
        text = some(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1] or ""
            text[rng.randrange(len(text) + 1) : 0] = re.split(" ", part)[: rng.choice([5, 10, 50])]
        docs.append((k, rng.choice([" ", "\n", ", "]).join(text)))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (3, "ONLY this\titem HERE, only"), (None, None), (61, ""), (62, "...")] + [(7, docs[7][1])] * 20
    return docs, items


@pytest.mark.parametrize("most_bytes", [32_000_000, 0])
def test_hits_against_a_plain_search(spark, monkeypatch, most_bytes):
    """With the windows broadcast and, as for large benchmarks, joined by a shuffle."""
    monkeypatch.setattr(module.join_checked, "__defaults__", (most_bytes,))
    monkeypatch.setattr(module.occurrences, "__defaults__", (most_bytes,))
    docs, items = tables()
    got = found(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    assert len(got) == len(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    some = 0
    for row, doc in zip(sorted(got, key=key), sorted(docs, key=key)):
        n, places, ids = plain(doc[1], items)
        assert (row.doc_id, row.text) == doc and row.leak_n_words == n
        assert set(p - 1 for p in row.leak_hits or []) == places and (row.leak_hits is None) == (not places)
        assert row.leak_n_items == len(ids) and row.leak_items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        some += bool(places)
    assert 10 < some < len(docs)


def test_removal(spark):
    docs, items = tables(2)
    rows = [(i, t, "kept", f"{k}") for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, f"{DOCS}, leak_hits string, row string")
    bench = spark.createDataFrame(items, ITEMS)
    left = without_documents(df, bench)
    assert left.columns == df.columns
    assert sorted(r.row for r in left.collect()) == sorted(r[3] for r in rows if not plain(r[1], items)[1])
    cut = {r.row: r for r in without_spans(df, bench).collect()}
    assert len(cut) == len(rows)
    for i, text, kept, row in rows:
        _, places, _ = plain(text, items)
        assert cut[row].leak_hits == kept and cut[row].doc_id == i
        assert words(cut[row].text) == [w for k, w in enumerate(words(text)) if k not in places]
        if not places:
            assert cut[row].text == text
    one = spark.createDataFrame([(1, "Keep (this), ONLY This item -- here; and that.")], DOCS)
    assert without_spans(one, bench).first().text == "Keep (this),  and that." or words(without_spans(one, bench).first().text) == ["keep", "this", "and", "that"]


def test_without_items_or_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], DOCS), spark.createDataFrame([], ITEMS)
    assert [r.leak_hits for r in found(docs, none).collect()] == [None, None]
    assert found(spark.createDataFrame([], DOCS), spark.createDataFrame([("x", "a b")], ITEMS)).collect() == []


def test_copies_of_items_and_documents(spark):
    """A third of all rows are one text, a third of all items as well: one row for it, with all items' ids."""
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, long)] * 300 + [(k, f"clean {k}") for k in range(600)], DOCS)
    items = spark.createDataFrame([(f"c{k}", long) for k in range(300)] + [(f"o{k}", f"other item {k}") for k in range(600)], ITEMS)
    met = hits(docs, items).collect()
    assert len(met) == 1 and met[0].leak_n_items == 300 and len(met[0].leak_hits) == 30
    assert found(docs, items).where("leak_n_items = 300").count() == 300


def test_a_very_long_text(spark):
    text = " ".join(f"v{i % 977}x{i % 31}" for i in range(200_000))
    part = " ".join(text.split()[150_000:150_012])
    got = found(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([("i", part)], ITEMS)).first()
    w = text.split()
    want = {j for i in range(len(w)) for k in range(3) if w[i : i + 10] == part.split()[k : k + 10] for j in range(i, i + 10)}
    assert got.leak_n_words == 200_000 and {p - 1 for p in got.leak_hits} == want
