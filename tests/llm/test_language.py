"""Language ID: sums and cosines against plain ones, held-out accuracy, several scripts, awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmill.llm import language
from brookmill.llm.language import DIMENSIONS, held_out, identified, learned, letter_vector
from brookmill.llm.query_language import op10_language
from brookmill.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in table(spark, FOLDER, "documents").select("doc_id", "lang").collect()}
    rows = op10_language(spark, FOLDER).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_awkward_rows(spark):
    rows = [(i, ("la casa de los ninos " if i % 2 else "the house of the children ") * (1 + i % 9), "es" if i % 2 else "en", "x") for i in range(200)]
    odd = [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, "the"), (1003, "the"), (None, "de los"), (1004, "casa de " * 400_000)]
    docs = spark.createDataFrame(rows + [(i, t, None, "x") for i, t in odd], "doc_id long, text string, lang string, lang_pred string")
    model = learned(docs, ~held_out(F.col("doc_id"), 4, 2))
    assert sorted(model) == ["en", "es"]
    got = identified(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd)
    pred = {}
    for r in found:
        pred.setdefault(r.doc_id, set()).add((r.lang_pred, r.lang_score > 0))
    assert all(pred[i] == {("es" if i % 2 else "en", True)} for i in range(200))
    assert pred[1000] == pred[1001] == pred[1002] == {("und", False)}
    assert pred[1003] == {("en", True)} and pred[None] == pred[1004] == {("es", True)}
    assert {r.lang_pred for r in identified(docs, {}).collect()} == {"und"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert learned(docs, F.lit(True)) == {} and identified(docs, {}).collect() == []


def plain_sum(text):
    """Letter by letter, without numpy's tricks."""
    low = [c.lower() if c.isalpha() else None for c in text]
    total = np.zeros(DIMENSIONS)
    for i, c in enumerate(low):
        if c:
            around = (low[i - 1] if i else None), c, (low[i + 1] if i + 1 < len(low) else None)
            first, second, third = (letter_vector(ord(x) if x else 0) for x in around)
            total += np.roll(first, 2) * np.roll(second, 1) * third
    return total


def test_sums_and_cosines_match_plain_ones(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abcdeé ABΣΩλжЖя漢字語 12.,\n"
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60))), "xyz"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = learned(docs, F.lit(True))
    for lang in "xyz":
        assert np.allclose(prototypes[lang], sum(plain_sum(t) for _, t, k in rows if k == lang))
    table = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in "xyz"])
    for r in identified(docs, prototypes).collect():
        own = plain_sum(r.text)
        if not own.any():
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
            continue
        cosines = table @ own / np.linalg.norm(own)
        assert r.lang_pred == "xyz"[int(np.argmax(cosines))] and abs(r.lang_score - max(cosines.max(), 0)) < 1e-6
    few = language.Profiles()
    monkeypatch.setattr(language, "KEPT", 5)
    monkeypatch.setattr(language, "PART", 7)
    parts = language.Profiles()
    for _, text, _ in rows:
        assert np.allclose(few.sum_of(text)[0], plain_sum(text)) and np.allclose(parts.sum_of(text)[0], plain_sum(text))


def test_scripts(spark):
    """Languages that share a script, in words of their own."""
    rng = random.Random(4)
    alphabets = {"ru": "абвгдежзийклмн", "bg": "опрстуфхцчшщъя", "el": "αβγδεζηθικλμ", "gr": "νξοπρστυφχψω", "zh": "的一是不了人我在有他", "ja": "これはのでをにがと日本", "he": "אבגדהוזחטיכל"}
    made = lambda lang: " ".join("".join(rng.choices(alphabets[lang], k=rng.randint(2, 5))) for _ in range(40))
    rows = [(i, made(lang), lang) for i, lang in enumerate(sorted(alphabets) * 20)]
    model = learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    new = spark.createDataFrame([(i, made(lang), lang) for i, lang in enumerate(sorted(alphabets) * 10)], "doc_id long, text string, lang string")
    assert all(r.lang == r.lang_pred and r.lang_score > 0.15 for r in identified(new, model).collect())
    vectors = np.stack([letter_vector(p) for p in [*range(0x410, 0x450), *range(0x4E00, 0x4E80)]])
    alike = np.abs(vectors @ vectors.T / DIMENSIONS - np.eye(len(vectors)))
    assert alike.max() < 0.2


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 10)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(11)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="different values"):
        learned(docs, F.lit(True))
    assert learned(docs.limit(0), F.lit(True)) == {}
