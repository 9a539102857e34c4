"""op13: every document's weight towards the benchmark, and the ranks of those drawn."""

from __future__ import annotations

from brookmill.llm.importance import ranked
from brookmill.sources.tables import table


def op13_importance(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = ranked(docs, table(spark, folder, "benchmark").select("text"))
    return out.selectExpr("doc_id", "imp_features AS n_features", "imp_weight AS weight", "imp_score AS score", "imp_rank AS rank")
