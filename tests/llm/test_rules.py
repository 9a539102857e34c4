"""Quality rules: base counts against plain Python, verdicts on clean and odd texts."""

import random
import re
from collections import Counter

from brookmill.llm.query_rules import op9_rules
from brookmill.llm.rules import judged, kept
from brookmill.session import shared_folder

SCHEMA = "doc_id long, text string, lang string, rule_words string"


def by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.5 else "".join(rng.choices("abcdefghinorstu", k=rng.randint(2, 9))) for _ in range(n))


def test_counts_and_verdicts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(60, 400)), "en" if i % 3 else None, "x") for i in range(200)]
    odd = [
        None, "", " \n\t\n", "a", "a b", "a b c", "a a a a", "x y z\nx y z\n\nx y z", "ab c d\n \n\te\x0bf", "# $%& <|> *",
        "the the the " * 300, " ".join(w + "###" for w in prose(rng, 300).split()), prose(rng, 30000), "é一 " * 60,
    ]
    rows += [(1000 + i, t, "en", None) for i, t in enumerate(odd)] + [(1000, None, "en", None)]
    got = judged(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n, chars, symbols, dup, rep = by_hand(text[r.doc_id] or "")
        assert (r.rule_words, r.rule_word_chars, r.rule_symbols, r.rule_dup_lines, r.rule_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.rule_base_failed == (n < 50 or 100 * rep > 50 * n)
        if r.doc_id < 1000 or r.doc_id == 1012:
            assert r.rule_kept
        else:
            assert not r.rule_kept
    assert {r.doc_id: r.rule_base_failed for r in got}[1011] is False
    docs = spark.createDataFrame(rows, SCHEMA)
    stay = kept(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(r.doc_id for r in got if r.rule_kept) and {r.rule_words for r in stay.collect()} <= {"x", None}


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_the_references_stay(spark):
    """Of the tables written on the way the one that the result reads is left, which has a row for each language."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()
    before = names()
    assert op9_rules(spark, "/root/testdata/sf0.001").count() == 200
    assert [n.rsplit("-", 1)[0] for n in names() - before] == ["rule-references"]
