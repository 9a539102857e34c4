"""The corpus pipeline: five operators in turn over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; all but the last return the columns of documents, whatever further
ones these have.

Null texts and texts without a letter go in the first stage. Rows with a null id
stay; of rows that repeat one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.llm.language import UNKNOWN, identified, learned
from brookmill.llm.minhash import one_of_each
from brookmill.llm.mixing import mixed
from brookmill.llm.packing import packed
from brookmill.llm.rules import kept
from brookmill.llm.store import discard, passing, set_apart, written
from brookmill.sources.tables import table

#: Least cosine with the nearest language's prototype for texts of fewer than so many characters, and beyond.
#: Other scripts and random letters reach 0.12 (99 of 100 of any length); texts in a language that was learned, of sf0.1,
#: 0.24 at least from 80 letters on, 0.14 from 20 on, 0.066 if shorter.
LEAST_COSINE = ((25, 0.06), (200, 0.125), (None, 0.2))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows have; those without letters or far from all languages go. A null lang becomes the one predicted."""
    prototypes = learned(docs.select("doc_id", "text", "lang"), F.lit(True))
    docs, back = set_apart(docs, ("doc_id", "text", "lang"))
    found = identified(docs, prototypes)
    least = F.coalesce(*[F.when(F.char_length("text") < n, score) for n, score in LEAST_COSINE[:-1]], F.lit(LEAST_COSINE[-1][1]))
    near = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least))
    return back(near.withColumn("lang", F.coalesce("lang", "lang_pred")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rules keep."""
    return kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed; a document taken twice is packed twice."""
    return packed(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("source mix", source_mix),
    ("packing", packing),
]

#: SQL cannot express the signatures, profiles and bins of these stages; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, and removed when the next one is there."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with passing() as tables:
            docs = written(stage(spark, before, sf_dir), f"stage-{name.replace(' ', '-')}")
            tables.keep(docs)
        if n:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
