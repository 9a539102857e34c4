"""op11: spelling variants among the words of all documents, some of which lose a letter first."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from brookmill.llm.spelling import variants, vocabulary
from brookmill.sources.tables import table

#: One of so many pairs of document and run loses a letter.
ONE_OF = 97


def op11_spelling(spark, folder):
    """A null id takes part as the empty string."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.split(low, r"[^a-zÀ-ÿ]+")).alias("run")).where("run != ''")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"), (h % F.greatest(F.char_length("run"), F.lit(1))).cast("int").alias("at"))
    word = F.when(F.col("h") % ONE_OF == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    return variants(vocabulary(runs.select(word.alias("word")))).select("word", "form", "root", "n", "n_near", "form_n")
