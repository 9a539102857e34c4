"""op1: the class of near duplicates of every document.

`kept` marks the rows with their class's id: where ids are unique, one of each
class. Rows that repeat that id are all marked, and so are all rows of a class
without ids (class_id null); minhash.one_of_each picks one row of these. A row
with a null id in a class with an id is not marked. `kept` is never null.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.minhash import near_classes
from brookmill.sources.tables import table


def op1_minhash(spark, folder):
    found = near_classes(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "class_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
