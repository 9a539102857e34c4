"""The pipeline's stages, each against a plain version on its own input."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brookmill.llm.language import lower_letters
from brookmill.llm.mixing import with_copies
from brookmill.llm.store import written
from brookmill.session import shared_folder
from tests.llm.test_minhash import classes_by_hand, shingles
from tests.llm.test_rules import by_hand

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, FOLDER), f"test-{name.replace(' ', '-')}")
        out.append((docs, new))
        docs = new
    return out


def check(spark, docs):
    steps = staged(spark, docs)
    for before, after in steps[:-1]:
        assert after.columns == before.columns and before.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    language, rules, near, mix, pack = ((a.collect(), b.collect()) for a, b in steps)
    letters = [r for r in language[0] if lower_letters()[[ord(c) for c in r.text or ""]].any()]
    assert not Counter(language[1]) - Counter(letters)
    assert all(r in letters for r in language[1]) and len(language[1]) >= 0.99 * len(letters)
    for r in rules[1]:
        n, _, _, _, repeated = by_hand(r.text)
        assert n >= 50 and 100 * repeated <= 50 * n
    want = classes_by_hand([(r.doc_id, r.text) for r in near[0]])
    label = lambda r: want[frozenset(shingles(r.text).items())]
    assert sorted(map(label, near[1])) == sorted(set(map(label, near[0]))) and set(near[1]) <= set(near[0])
    assert all(r.doc_id == label(r) for r in near[1])
    copies = Counter()
    for r in with_copies(steps[3][0]).collect():
        copies[r.doc_id] += r.mix_copies
    assert Counter(r.doc_id for r in mix[1]) == +copies
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = Counter(), defaultdict(list)
    for r in pack[0]:
        ids = whole.encode(r.text, add_special_tokens=False).ids + [1]
        pieces.update((r.doc_id, k, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    for r in pack[1]:
        bins[r.sequence_id].append((r.offset, r.length))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in pack[1]) == pieces
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 4096
    return [len(after) for _, after in (language, rules, near, mix, pack)]


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = check(spark, docs)
    assert 0 < sizes[2] < sizes[1] < sizes[0]
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes[-1]


def test_awkward_rows_and_empty_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "1 2 3", "en", None, 5), (903, " \n", None, None, 2), *rows[:5]]
    clashing = ["rule_words", "ref_common", "lang_pred", "near_text", "near_handle", "mix_size", "pack_group", "carried_1", "a.b"]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(spark, docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clashing}))
    for _, after in staged(spark, spark.createDataFrame([], SCHEMA)):
        assert after.count() == 0


def test_language_stage_rejects_other_scripts_and_random_letters(spark):
    rng = random.Random(2)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = ["".join(rng.choices(letters, k=n)) for letters in ("абвгдежзиклмнопрст ", "αβγδεζηθικλμνξο ", "的一是不了人我在有他这", "abcdefghijklmnopqrstuvwxyz ", "qxzjkvw ") for n in (60, 150, 300, 3000) for _ in range(5)]
    docs = spark.createDataFrame(rows + [(10_000 + i, t, None, None, len(t)) for i, t in enumerate(odd)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()}
    assert sum(i >= 10_000 for i in kept) <= 2 and sum(i < 10_000 for i in kept) >= len(rows) - 1


def test_stages_leave_nothing_in_the_shared_folder(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} <= {"stage-source-mix", "packed"}
