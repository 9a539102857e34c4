"""op4: every document in packed rows of ids."""

from __future__ import annotations

from brookmill.llm.sequences import sequences
from brookmill.sources.tables import table


def op4_sequences(spark, folder):
    return sequences(table(spark, folder, "documents").select("doc_id", "text"))
