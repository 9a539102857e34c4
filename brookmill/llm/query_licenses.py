"""op3: license notices in every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.licenses import BASE, scanned
from brookmill.sources.tables import table


def op3_licenses(spark, folder):
    found = scanned(table(spark, folder, "documents").select("doc_id", "text"))
    hits = F.col("license_hits")
    base = F.filter(hits, lambda h: (h["errors"] == 0) & h["phrase"].isin([p for p, _ in BASE]))
    starts = F.transform(base, lambda h: h["first_word"])
    sure = F.filter(hits, lambda h: h["sure"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda h: h["label"]))), ",")
    score = F.array_max(F.transform(sure, lambda h: 1 - h["errors"] / 4.0))
    return found.select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(sure).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )
