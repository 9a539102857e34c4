"""op8: which earlier response answers each revisit.

`pages` has full responses only. Its query makes two captures of each page: the
response at time page_id, and at time page_id + 500 a revisit, which carries in
turn a weak entity tag, Last-Modified, another entity tag, the payload digest,
or another digest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmill.llm.revisits import TRACKING, resolved
from brookmill.sources.tables import table

LATER = 500


def captures(pages):
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", F.md5(html).alias("sum"), F.octet_length(html).cast("string").alias("size"))
    tag, modified, kind = F.substring("sum", 1, 16), F.concat(F.lit("page "), F.col("page_id").cast("string")), F.col("page_id") % 5
    header = lambda name, value, when=F.lit(True): F.struct(F.lit(name).alias("key"), F.when(when, value).alias("value"))
    quoted = lambda x, mark="": F.concat(F.lit(f'{mark}"'), x, F.lit('"'))
    present = lambda *entries: F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    response = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", F.col("page_id").alias("time"), F.lit(False).alias("is_revisit"),
        present(header("Content-Type", F.lit("text/html")), header("Content-Length", F.col("size")), header("ETag", quoted(tag)), header("Last-Modified", modified), header("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.col("sum").alias("digest"),
    )
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (F.col("page_id") + LATER).alias("time"), F.lit(True).alias("is_revisit"),
        present(header("content-length", F.lit("0")), header("cache-control", F.lit("max-age=600")), header("etag", F.when(kind == 0, quoted(tag, "W/")).otherwise(F.lit('"changed"')), kind.isin(0, 2)), header("last-modified", modified, kind == 1)).alias("headers"),
        F.when(kind == 3, F.col("sum")).when(kind == 4, F.md5("url")).alias("digest"),
    )
    return response.unionByName(revisit)


def op8_revisits(spark, folder):
    found = resolved(captures(table(spark, folder, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.map_entries("revisit_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id", F.floor(F.col("record_id") / 2).alias("page_id"), F.col("revisit_url").alias("canonical_url"), "time", "is_revisit",
        F.col("revisit_of").alias("answered_by"), F.col("revisit_reason").alias("reason"), F.array_join(F.array_sort(lines), "\n").alias("headers"),
    )


SQL = rf"""
WITH parts AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM pages
), cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/index\.html?$', '/') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS params FROM parts
), named AS (
  SELECT *, 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '(.)/$', '\1')
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url,
         page_id % 5 AS kind, '"' || substr(digest, 1, 16) || '"' AS tag FROM cut
), asked AS (
  SELECT r.*, f.page_id AS answer, f.digest AS f_digest, f.tag AS f_tag, f.size AS f_size
  FROM named r LEFT JOIN LATERAL (SELECT * FROM named f WHERE f.canonical_url = r.canonical_url AND f.page_id < r.page_id + {LATER} ORDER BY f.page_id DESC LIMIT 1) f ON true
), judged AS (
  SELECT *, CASE WHEN answer IS NULL THEN 'no response'
                 WHEN kind = 0 AND tag <> f_tag OR kind = 2 THEN 'etag'
                 WHEN kind = 1 AND answer <> page_id THEN 'last-modified'
                 WHEN kind = 3 AND digest <> f_digest OR kind = 4 AND md5(url) <> f_digest THEN 'digest'
                 ELSE 'resolved' END AS reason FROM asked
)
SELECT 2 * page_id AS record_id, page_id, canonical_url, page_id AS time, false AS is_revisit, NULL::BIGINT AS answered_by, NULL::VARCHAR AS reason,
       'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: page ' || page_id AS headers
FROM named
UNION ALL
SELECT 2 * page_id + 1, page_id, canonical_url, page_id + {LATER}, true, CASE WHEN reason = 'resolved' THEN 2 * answer END, reason,
       CASE WHEN reason = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || f_size || chr(10) || 'content-type: text/html' || chr(10)
            || 'etag: ' || CASE WHEN kind = 0 THEN 'W/' || tag ELSE f_tag END || chr(10) || 'last-modified: page ' || answer END
FROM judged"""
