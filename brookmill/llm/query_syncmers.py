"""op7: fingerprints of every document and of its edited text."""

from __future__ import annotations

from brookmill.llm.syncmers import fingerprints
from brookmill.sources.tables import table


def op7_syncmers(spark, folder):
    return fingerprints(table(spark, folder, "documents").select("doc_id", "text"))
