"""All registered queries of this subpackage on empty tables, and on one with nulls, odd and long texts, repeated rows and clashing columns."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from brookmill.llm.queries import QUERIES

SOURCE = "/root/testdata/sf0.001"
CLASHING = ("lang_pred", "mix_size", "near_key", "rule_words", "ref_common", "part", "key", "row", "size", "pack_group", "class_id", "carried_0", "leak_hits", "imp_rank", "imp_row", "word", "id", "scan_piece")
ALL = QUERIES | {"pipeline": corpus_pipeline.run}
#: Columns that may be null besides ids.
MAY_BE_NULL = {"op3_licenses": {"first_word", "last_word"}, "op11_spelling": {"form", "form_n"}, "op13_importance": {"rank"}}


def tables(folder, documents, pages):
    for name in os.listdir(SOURCE):
        if name not in ("documents.parquet", "pages.parquet"):
            os.symlink(f"{SOURCE}/{name}", folder / name)
    pq.write_table(documents, folder / "documents.parquet")
    pq.write_table(pages, folder / "pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def given():
    return {name: pq.read_table(f"{SOURCE}/{name}.parquet") for name in ("documents", "pages")}


@pytest.fixture(scope="module")
def empty(given, tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), given["documents"].slice(0, 0), given["pages"].slice(0, 0))


@pytest.fixture(scope="module")
def odd(given, tmp_path_factory):
    docs = given["documents"].to_pylist()[:40]
    row = lambda doc_id, text, lang, source: {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": None}
    long = " ".join(f"w{i * 7919 % 10007} mot{i % 31}" for i in range(30_000))
    texts = [None, "", " ", "\n\t", "a", "ß", "日本語 テキスト", "😀 😀", "\x00 nul", "mit license", long, f"{long} end", "x" * 100_000, "the " * 20_000]
    rows = docs + [row(None if k % 3 == 0 else 9000 + k, t, None if k % 2 else "en", None if k % 4 == 0 else "srcZ") for k, t in enumerate(texts)]
    rows += [dict(docs[3])] * 60 + [row(None, None, None, None)] * 60 + [row(77, d["text"], "zz", "") for d in docs[:10]]
    schema = given["documents"].schema
    for c in CLASHING:
        schema = schema.append(pa.field(c, pa.string()))
    pages = given["pages"].to_pylist()
    pages += [pages[0] | {"url": None}, pages[1] | {"html": None}, pages[2] | {"page_id": None}] + [pages[3]] * 5
    return tables(tmp_path_factory.mktemp("odd"), pa.Table.from_pylist([r | dict.fromkeys(CLASHING, "c") for r in rows], schema=schema), pa.Table.from_pylist(pages, schema=given["pages"].schema))


@pytest.mark.parametrize("name", ALL)
def test_empty(spark, empty, name):
    assert ALL[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ALL)
def test_odd(spark, odd, name):
    out = ALL[name](spark, odd)
    rows = out.collect()
    many = pq.read_metadata(f"{odd}/documents.parquet").num_rows
    if name not in ("op2_packing", "op4_sequences", "op8_revisits", "op11_spelling", "pipeline"):
        assert len(rows) == many
    if name == "op2_packing":
        assert sum(r.piece == 0 for r in rows) == many
    if name == "op1_minhash":
        assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
        assert all(r.class_size > 1 or r.kept for r in rows)
    if name != "op8_revisits":
        known = set(out.columns) - {"doc_id", "class_id"} - MAY_BE_NULL.get(name, set())
        assert all(r[c] is not None for r in rows for c in known)
