"""Resolution of not-modified revisits in a table of web captures.

A capture is a full response or a revisit, the record of a server's "304 not
modified". For each revisit the latest earlier full response of its canonical
URL is looked up (an as-of join). It answers the revisit if no validator speaks
against it: entity tags must be equal by weak comparison where both have one;
else Last-Modified must be equal where both have one; a payload digest that both
give must be equal. The resolved headers are those of the response, with those
of the revisit that a 304 may change in their place.

The as-of join works on one narrow row per URL and time, made by combining
within tasks, and in two levels: within pieces of a URL's times, and over the
last responses of the pieces before. Pieces are cut at quantiles of all times,
one for each few million URLs and times, so a URL with a third of all captures
is spread over more tasks the more there are, and captures of one URL and time
never meet as rows. Bodies are not moved.

Canonical form: scheme http, lower-case host without "www.", "m." and default
port, path without a closing slash (but the root) or a default document, query
parameters sorted, without those that only track, no fragment.

Nulls: a null URL or time is not resolved; null headers are empty ones; header
names count in lower case, the last of several alike wins; a validator without a
value is none, and a null value replaces none. A response with a null id answers
nothing, as it can't be named. Captures of one time
are not earlier than each other; of several responses of one time the greatest
id answers. Repeated rows are resolved alike; an empty table gives an empty
result. Input columns stay, clashing ones with the prefix `revisit_` are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.llm.store import passing, written
from brookmill.operators.groups import cut

# Headers of a 304 that replace those stored.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age")
# Query parameters that only say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """The canonical form of a URL; null for null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1), r"/index\.html?$", "/")
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"(.)/$", "$1")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(F.lit("http://"), host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def by_name(headers: Column) -> Column:
    """Headers with names in lower case; the last of several alike wins."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


def strong(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def mismatch(response: Column, revisit: Column) -> Column:
    """Why the response can't be what the revisit was answered with; null if it can. Both have headers and digest."""
    get = lambda x, name: F.element_at(x["headers"], F.lit(name))
    tags = get(response, "etag").isNotNull() & get(revisit, "etag").isNotNull()
    times = get(response, "last-modified").isNotNull() & get(revisit, "last-modified").isNotNull()
    return (
        F.when(tags & (strong(get(response, "etag")) != strong(get(revisit, "etag"))), F.lit("etag"))
        .when(~tags & times & (get(response, "last-modified") != get(revisit, "last-modified")), F.lit("last-modified"))
        .when(response["digest"] != revisit["digest"], F.lit("digest"))
    )


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers with those that the revisit may change in their place."""
    changed = F.map_filter(revisit, lambda k, v: k.isin(*UPDATED) & v.isNotNull())
    kept = F.map_filter(response, lambda k, v: ~F.map_contains_key(changed, k))
    return F.map_concat(kept, changed)


def resolved(captures: DataFrame, pieces: int | None = None) -> DataFrame:
    """captures with revisit_url (canonical), revisit_of (the id of the response
    that answers), revisit_reason (of revisits: "resolved", "no response" or the
    validator that differs) and revisit_headers (of responses their own, of
    resolved revisits the merged ones, else null).

    Columns read: record_id, url, time (long), is_revisit, headers
    (map<string,string>), digest. Times are cut into so many pieces, or by their number.
    """
    captures = captures.drop("revisit_url", "revisit_of", "revisit_reason", "revisit_headers")
    names = captures.columns
    rows = captures.withColumns({"revisit_url": canonical(F.col("url")), "revisit_own": by_name(F.col("headers"))})
    revisit = F.coalesce("is_revisit", F.lit(False))
    full = F.when(~revisit, F.struct(F.col("record_id").alias("record_id"), F.col("revisit_own").alias("headers"), F.col("digest").alias("digest")))
    points = rows.where("revisit_url is not null and time is not null").groupBy("revisit_url", "time").agg(F.max_by(full, F.when(~revisit, F.col("record_id"))).alias("response"))
    with passing() as tables:
        points, pieces = cut(written(points, "revisit-points"), "time", pieces)
        within = W.partitionBy("revisit_url", "piece").orderBy("time").rowsBetween(W.unboundedPreceding, -1)
        found = points.select("revisit_url", "time", "piece", F.last("response", ignorenulls=True).over(within).alias("revisit_found"))
        if pieces > 1:
            ends = points.groupBy("revisit_url", "piece").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.col("time"))).alias("end"))
            before = W.partitionBy("revisit_url").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
            carried = ends.select("revisit_url", "piece", F.last("end", ignorenulls=True).over(before).alias("carried"))
            found = found.join(carried, ["revisit_url", "piece"]).withColumn("revisit_found", F.coalesce("revisit_found", "carried"))
        found = written(found.select("revisit_url", "time", "revisit_found"), "revisit-found")
        tables.keep(found)
    asked = rows.where(revisit).join(found, ["revisit_url", "time"], "left")
    own = F.struct(F.col("revisit_own").alias("headers"), F.col("digest").alias("digest"))
    reason = F.when(F.col("revisit_found").isNull(), F.lit("no response")).otherwise(F.coalesce(mismatch(F.col("revisit_found"), own), F.lit("resolved")))
    asked = asked.withColumn("revisit_reason", reason).select(
        *names, "revisit_url", F.when(F.col("revisit_reason") == "resolved", F.col("revisit_found")["record_id"]).alias("revisit_of"), "revisit_reason",
        F.when(F.col("revisit_reason") == "resolved", merged(F.col("revisit_found")["headers"], F.col("revisit_own"))).alias("revisit_headers"),
    )
    kind = captures.schema["record_id"].dataType
    responses = rows.where(~revisit).select(*names, "revisit_url", F.lit(None).cast(kind).alias("revisit_of"), F.lit(None).cast("string").alias("revisit_reason"), F.col("revisit_own").alias("revisit_headers"))
    return responses.unionByName(asked)
