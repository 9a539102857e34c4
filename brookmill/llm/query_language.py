"""op10: the language of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.language import held_out, identified, learned
from brookmill.sources.tables import table


def op10_language(spark, folder):
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    prototypes = learned(docs.select("doc_id", "text", "lang"), ~out)
    scored = identified(docs.select("doc_id", "text"), prototypes)
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
