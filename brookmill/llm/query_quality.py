"""op6: a quality score of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.quality import learned, scored
from brookmill.llm.store import join_checked, passing, written
from brookmill.sources.tables import table


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    with passing():
        model = learned(join_checked(docs, written(labels, "quality-labels"), ["doc_id"], "inner"))
    found = scored(docs, model)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )
