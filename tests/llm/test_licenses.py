"""License notices: exact places against a plain search, edits found within their bounds."""

import random
import re

import numpy as np

from brookmill.llm import licenses
from brookmill.llm.licenses import BASE, NOTICES, errors_allowed, finder, scanned, words_of
from brookmill.llm.query_licenses import op3_licenses
from brookmill.sources.tables import table

SEARCH = finder(BASE + NOTICES)
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_places(text):
    words = re.findall(PATTERN, ascii_lower(text))
    return len(words), [(i, label) for phrase, label in BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def edits(a, b):
    row = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def texts(rng):
    pool = ["mit", "license", "apache", "general", "public", "licence", "mit license", "the", "commit license", "emit", "licenses", "é", "gnu", "MIT", "License,"]
    return [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "mit license", "mit license mit license mit license", "mit" * 9000 + " license", "MIT\nLicense;GENERAL  public-license", "İmit license"]


def test_exact_places(spark):
    rows = list(enumerate(texts(random.Random(1)))) + [(3, "mit license"), (None, "apache license")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, license_words int")
    got = scanned(docs)
    assert got.columns == ["doc_id", "text", "license_words", "license_hits"]
    found = got.collect()
    assert len(found) == len(rows)
    base = {p for p, _ in BASE}
    for r in found:
        n, places = base_places(r.text or "")
        assert r.license_words == n
        assert sorted((h.first_word, h.label) for h in r.license_hits if h.errors == 0 and h.phrase in base) == sorted(places)
        words = words_of(r.text or "")
        for h in r.license_hits:
            assert h.text == " ".join(words[h.first_word : h.last_word + 1])
            assert edits(h.phrase, h.text) == h.errors <= errors_allowed(h.phrase)


def test_edited_notices_are_found():
    rng = random.Random(2)
    for phrase, label in BASE + NOTICES:
        for _ in range(40):
            t = list(phrase)
            for _ in range(rng.randint(0, errors_allowed(phrase))):
                k = rng.randrange(1, len(t) - 1)
                if rng.random() < 0.4:
                    t[k] = rng.choice("abcdefgh")
                elif rng.random() < 0.5:
                    del t[k]
                else:
                    t.insert(k, rng.choice("abcdefgh"))
            text = "zonk und " + "".join(t) + " orble es"
            hits = SEARCH.hits(text.split())
            assert any(h[1] == phrase for h in hits) and label in {h[0] for h in hits}
    assert SEARCH.hits("nothing of that kind is written here in public or in general".split()) == []


def test_sure_matches():
    sure = lambda text: {h[0] for h in SEARCH.hits(text.split()) if h[6]}
    for text in ("bit license", "a mid license", "released under the bsd license", "licensed under my by", "licensed under a b"):
        assert sure(text) == set() and SEARCH.hits(text.split()) != [] or "under a b" in text
    for text, label in (("mit licence", "mit"), ("apache licens", "apache"), ("released unter the mit license", "mit"), ("mozila public licence", "mpl"), ("permission is hereby granted free of charge to ani person obtaning a copy", "mit")):
        assert label in sure(text)


#: Like notices, but none: within the errors of one, or nearly.
NEAR_MISSES = (
    "general publicity license", "general public licensing", "generic public license", "several public license", "general republic license", "generous public license", "general public silence",
    "bit license", "mid license", "hit license", "a pit license", "unit license", "apache licensing", "apaches silence", "a pace license", "patch license", "cache license",
    "mozart public license", "eclipsed publicly licensed", "php licensing", "pop license", "a public license", "zone public license", "artistic licensing", "autistic silence",
    "open database listing", "open hardware license", "boots software sense", "creative common distribution", "common publicity licenses", "universal submissive licence",
)


def test_near_misses_have_no_label_and_edited_notices_have():
    """Precision and recall of labels among planted phrases: notices with one error in a word of five letters or more, or two
    in long ones, against like phrases that are none, in running text."""
    rng = random.Random(5)
    labels = lambda text: {h[0] for h in SEARCH.hits(words_of(f"lorem ipsum {text} dolor sit"))  if h[6]}
    false = [m for m in NEAR_MISSES if labels(m)]
    found = asked = 0
    for phrase, label in BASE + NOTICES:
        for _ in range(20):
            words = phrase.split()
            for n in rng.sample([k for k, w in enumerate(words) if len(w) > 4], 2 if len(phrase) >= 35 else 1):
                w = list(words[n])
                k = rng.randrange(1, len(w) - 1)
                kind = rng.randrange(3)
                w[k : k + (kind > 0)] = [[rng.choice("xyz"), w[k]], [], [rng.choice("xyz")]][kind] if kind != 0 else [rng.choice("xyz")]
                words[n] = "".join(w)
            asked += 1
            found += label in labels(" ".join(words))
    assert false == [] and found / asked > 0.97
    assert labels("mti license") == labels("mitlicense") == set() and labels("apache lciense") == {"apache"}


def test_no_false_labels_in_texts_without_notices(spark):
    """Documents of the tables whose words of notices were taken out."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").collect()
    notice_words = {w for p, _ in BASE + NOTICES for w in p.split() if len(w) > 3}
    texts = [" ".join(w for w in words_of(r.text or "") if w not in notice_words) for r in rows]
    assert sum(any(h[6] for h in SEARCH.hits(t.split())) for t in texts) == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    for r in op3_licenses(spark, folder).collect():
        n, places = base_places(text[r.doc_id])
        starts, labels = [p for p, _ in places], sorted({x for _, x in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and r.labels.split(",") == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
    assert scanned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
