"""op2: where each piece of each document is packed."""

from __future__ import annotations

from brookmill.llm.packing import packed
from brookmill.sources.tables import table


def op2_packing(spark, folder):
    return packed(table(spark, folder, "documents").select("doc_id", "text"))
