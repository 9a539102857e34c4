"""Revisits: against a plain loop over captures in time order, canonical URLs, awkward rows."""

import random

from pyspark.sql import functions as F

from brookmill.llm.revisits import UPDATED, canonical, resolved

SCHEMA = "record_id long, url string, time long, is_revisit boolean, headers map<string,string>, digest string, revisit_of string"


def test_canonical_urls(spark):
    cases = {
        "http://www.a.example/x/?utm_source=feed&b=2&a=1#top": "http://a.example/x?a=1&b=2",
        "https://A.example:443": "http://a.example/", "m.a.example/index.html": "http://a.example/", "http://a.example?q=1": "http://a.example/?q=1",
        "http://a.example/X/index.htm?ref=x": "http://a.example/X", " http://a.example// ": "http://a.example/", None: None, "": "http:///",
    }
    got = {r.url: r.c for r in spark.createDataFrame([(u,) for u in cases], "url string").select("url", canonical(F.col("url")).alias("c")).collect()}
    assert got == cases


def by_loop(rows):
    out = []
    for r in rows:
        rid, url, time, revisit, headers, digest = r[:6]
        own = {}
        for k, v in (headers or {}).items():
            own[k.lower()] = v
        if not revisit:
            out.append((rid, None, None, tuple(sorted(own.items()))))
            continue
        best = None
        for o in rows:
            if o[1] == url and url is not None and not o[3] and None not in (o[0], o[2], time) and o[2] < time and (best is None or (o[2], o[0]) > (best[2], best[0])):
                best = o
        if best is None:
            out.append((rid, None, "no response", None))
            continue
        theirs = {k.lower(): v for k, v in (best[4] or {}).items()}
        bare = lambda t: t.removeprefix("W/")
        has = lambda name: own.get(name) is not None and theirs.get(name) is not None
        tags, times = has("etag"), has("last-modified")
        if tags and bare(own["etag"]) != bare(theirs["etag"]):
            out.append((rid, None, "etag", None))
        elif not tags and times and own["last-modified"] != theirs["last-modified"]:
            out.append((rid, None, "last-modified", None))
        elif None not in (digest, best[5]) and digest != best[5]:
            out.append((rid, None, "digest", None))
        else:
            headers = theirs | {k: v for k, v in own.items() if k in UPDATED and v is not None}
            out.append((rid, best[0], "resolved", tuple(sorted(headers.items()))))
    return out


def test_resolution_matches_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        url = "http://hot.example/" if rng.random() < 0.4 else f"http://s{rng.randint(0, 40)}.example/"
        headers = {k: v for k, v in [("ETag", rng.choice(['"a"', 'W/"a"', '"b"'])), ("Last-Modified", rng.choice("xy")), ("Content-Length", str(i)), ("Cache-Control", str(i)), ("Server", "s")] if rng.random() < 0.5}
        rows.append((i, url, rng.choice([rng.randint(0, 3000), 700]), rng.random() < 0.5, headers, rng.choice(["d1", "d1", "d2", None]), "x"))
    rows += [(2000, None, 5, True, None, None, "x"), (2001, "http://hot.example/", None, True, {}, None, "x"), (2002, "http://hot.example/", None, False, None, "d1", "x"), (2003, "http://new.example/", 9000, None, {"A": "1"}, None, "x"), (2004, "http://new.example/", 9001, True, {"a": "2"}, None, "x"), (2004, "http://new.example/", 9001, True, {"a": "2"}, None, "x")]
    rows += [(3000, "http://n.example/", 10, False, {"ETag": None, "A": None, "Age": "1"}, None, "x"), (None, "http://n.example/", 15, False, {"ETag": '"b"'}, "d9", "x"), (3001, "http://n.example/", 20, True, {"etag": '"a"', "Age": None}, None, "x"), (None, "http://n.example/", 21, True, None, None, "x")]
    for pieces in (None, 7, 64):
        got = resolved(spark.createDataFrame(rows, SCHEMA).repartition(5), pieces)
        assert got.columns == ["record_id", "url", "time", "is_revisit", "headers", "digest", "revisit_url", "revisit_of", "revisit_reason", "revisit_headers"]
        found = [(r.record_id, r.revisit_of, r.revisit_reason, None if r.revisit_headers is None else tuple(sorted(r.revisit_headers.items()))) for r in got.collect()]
        assert sorted(found, key=repr) == sorted(by_loop(rows), key=repr)


def test_empty_table(spark):
    assert resolved(spark.createDataFrame([], SCHEMA)).collect() == []
