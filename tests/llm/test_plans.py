"""Plans: operators that are to use DataFrame functions only have no Python in them; scans read the columns they need."""

import re

import pytest
from pyspark.sql import DataFrame

from brookmill.llm import queries
from brookmill.llm.decontamination import item_windows, occurrences, without_spans, words_of
from brookmill.llm.mixing import source_targets
from brookmill.llm.rules import references
from brookmill.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["op5_mixing", "op9_rules", "op12_decontamination"])
def test_native_operators_have_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, FOLDER)))


def test_inner_steps_have_no_python(spark):
    docs = table(spark, FOLDER, "documents")
    windows, members = item_windows(table(spark, FOLDER, "benchmark"))
    met = occurrences(docs.select(words_of(docs["text"]).alias("leak_words"), docs["doc_id"].cast("string").alias("leak_key")), windows)
    for step in (references(docs, 0.01, 1000), source_targets(docs.selectExpr("source", "n_chars AS size")), met, members, without_spans(docs, table(spark, FOLDER, "benchmark"))):
        assert not re.search("Python|Pandas|Arrow", plan(step))


@pytest.mark.parametrize("name,unused", [("op2_packing", "lang"), ("op3_licenses", "source"), ("op5_mixing", "n_chars"), ("op7_syncmers", "source")])
def test_scans_read_only_what_is_needed(spark, name, unused):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", plan(queries.QUERIES[name](spark, FOLDER)))
    assert schemas and not any(re.search(rf"\b{unused}:", s) for s in schemas)


def test_no_cartesian_products(spark):
    for name, query in queries.QUERIES.items():
        assert "CartesianProduct" not in plan(query(spark, FOLDER)), name
