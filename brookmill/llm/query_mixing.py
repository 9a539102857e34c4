"""op5: what the mix takes of each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.mixing import with_copies
from brookmill.sources.tables import table


def op5_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(md5(text), '') AS text_md5,
         row_number() OVER (PARTITION BY doc_id, text, source) AS number
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM totals
), levels AS (
  SELECT *, row_number() OVER filling AS place,
         ((SELECT sum(source_size)::DOUBLE FROM totals) - coalesce(sum(cap) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM weighed WINDOW filling AS (ORDER BY cap / w, source ASC NULLS LAST)
), settled AS (
  SELECT level FROM levels WHERE w * level <= cap ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM settled)) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END, 3.0::DOUBLE) AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.text_md5 || ':' || s.number), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated"""
