"""op12: words of every document that stand in windows of benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.decontamination import found
from brookmill.sources.tables import table


def op12_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return found(docs, table(spark, folder, "benchmark").select("item_id", "text")).select(
        "doc_id",
        F.col("leak_n_words").alias("n_words"),
        F.coalesce(F.size("leak_hits"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.col("leak_n_items").alias("n_items"),
        F.col("leak_items_sha256").alias("items_sha256"),
        F.col("leak_hits").isNotNull().alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS width, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS w
  FROM items, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS t(i) WHERE len(words) > 0
), widths AS (SELECT DISTINCT width FROM windows
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS words FROM documents
), scanned AS (
  SELECT row, i, width, array_to_string(words[i:i + width - 1], ' ') AS w
  FROM docs, widths, unnest(range(1, greatest(len(words) - width + 2, 1))) AS t(i)
), met AS (
  SELECT row, i, width, item_id FROM scanned JOIN windows USING (width, w)
), hit AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + width)) AS place FROM met) GROUP BY row
), listed AS (
  SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM met) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN listed USING (row)"""
