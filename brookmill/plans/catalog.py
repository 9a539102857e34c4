"""Registered relational queries, each beside its SQL form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.columns import day, exact, mean, moment, money, revenue
from brookmill.operators.groups import distinct_by_parts, sessions, top_per_group
from brookmill.operators.joins import asof_join, overlap_join, range_join, uneven_join
from brookmill.operators.neighbours import nearest, usable
from brookmill.operators.patterns import matches
from brookmill.operators.quantiles import quantiles
from brookmill.operators.scans import first, lag, lead, moving_sum, ntile, ordered, percent_rank, rank, running_sum
from brookmill.operators.skyline import skyline
from brookmill.operators.summaries import estimates, frequent_values, merged, summaries
from brookmill.session import setting, shared_folder
from brookmill.sources import keyed
from brookmill.sources.tables import table
from brookmill.sources.written import written
from brookmill.streaming.joins import interval_join
from brookmill.streaming.sessions import STORE, stream_sessions
from brookmill.streaming.windows import counts_by_window, emitted, events, in_batches, run_all, without_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (read, spark, folder), where read(name) is a table, with its SQL if that can say it."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name), spark, folder)
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS sum_qty,
       sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS sum_base_price,
       round(sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))), 2)::DOUBLE AS sum_disc_price,
       ((20000 * sum(round(l_discount * 100)::BIGINT) + count(l_discount)) // (2 * count(l_discount))) / 1000000.0::DOUBLE AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(read, spark, folder):
    """Sums and means of line items by return flag and status."""
    return read("lineitem").where(F.col("l_shipdate") <= ntz("1998-09-02")).groupBy("l_returnflag", "l_linestatus").agg(
        money(F.sum(exact("l_quantity"))).alias("sum_qty"),
        money(F.sum(exact("l_extendedprice"))).alias("sum_base_price"),
        money(F.sum(revenue())).alias("sum_disc_price"),
        mean("l_discount", 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, round(sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))), 2)::DOUBLE AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def unshipped_orders(read, spark, folder):
    """The ten open orders of a segment with the greatest revenue."""
    c = read("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = read("orders").where(F.col("o_orderdate") < ntz("1998-03-15"))
    items = read("lineitem").where(F.col("l_shipdate") > ntz("1998-03-15"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(items, items.l_orderkey == o.o_orderkey)
    sums = joined.groupBy("o_orderkey", day("o_orderdate").alias("o_orderdate")).agg(money(F.sum(revenue())).alias("revenue"))
    return sums.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""
SELECT n_name, round(sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))), 2)::DOUBLE AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def local_supplier_volume(read, spark, folder):
    """Revenue within each nation of a region, customer and supplier being of that nation."""
    nations = read("nation").join(read("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    bought = read("customer").join(read("orders"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    items = read("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return items.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).groupBy("n_name").agg(money(F.sum(revenue())).alias("revenue"))


@query("""
SELECT round(sum(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2)), 2)::DOUBLE AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def discount_revenue(read, spark, folder):
    """What certain discounts cost in a year."""
    rows = read("lineitem").where((F.col("l_shipdate") >= ntz("1996-01-01")) & (F.col("l_shipdate") < ntz("1997-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(money(F.sum(exact("l_extendedprice") * exact("l_discount", 4))).alias("revenue"))


@query("""
SELECT o_orderpriority, count(*) AS order_count FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R') GROUP BY ALL""")
def returned_orders(read, spark, folder):
    """Orders with a returned item, by priority (semi join)."""
    returned = read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read("orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@query("""
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')""")
def lost_customers(read, spark, folder):
    """Customers without an order since a day (anti join)."""
    recent = read("orders").where(F.col("o_orderdate") >= ntz("2000-06-01")).select(F.col("o_custkey").alias("c_custkey"))
    return read("customer").join(recent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
SELECT n, count(*) AS customers FROM (
  SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey
) GROUP BY n""")
def orders_per_customer(read, spark, folder):
    """How many customers have how many orders (outer join)."""
    o = read("orders").where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    each = read("customer").join(o, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return each.groupBy("n").agg(F.count("*").alias("customers"))


@query("""
SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS suppliers FROM
  (SELECT c_nationkey + 3 AS k, count(*) AS n FROM customer GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) b ON a.k = b.k""")
def nations_of_both(read, spark, folder):
    """Counts of two tables side by side (full outer join)."""
    a = read("customer").groupBy((F.col("c_nationkey") + 3).alias("k")).agg(F.count("*").alias("orders"))
    b = read("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("""
SELECT round(100.0::DOUBLE * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) ELSE 0 END)::DOUBLE / sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE, 4) AS promo_share
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def promo_share(read, spark, folder):
    """Share of revenue with a part type (conditional aggregation)."""
    joined = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.agg(F.round(100.0 * F.sum(F.when(F.col("p_type") == "PROMO", revenue()).otherwise(0)).cast("double") / F.sum(revenue()).cast("double"), 4).alias("promo_share"))


@query("""
SELECT o_orderkey, o_custkey, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY ALL HAVING sum(l_quantity) > 250""")
def large_orders(read, spark, folder):
    """Orders above a sum; items are added up before they meet their orders."""
    sums = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity")).where("quantity > 250")
    return read("orders").join(sums, "o_orderkey").select("o_orderkey", "o_custkey", "quantity")


@query("""
SELECT p_partkey, p_brand, p_retailprice FROM part p
WHERE (SELECT count(*) * (p.p_retailprice::DECIMAL(12,2) - 40) > sum(p_retailprice::DECIMAL(12,2)) FROM part WHERE p_brand = p.p_brand)""")
def dear_parts(read, spark, folder):
    """Parts well above their brand's mean (correlated subquery as aggregate and join)."""
    brands = read("part").groupBy("p_brand").agg(F.sum(exact("p_retailprice")).alias("total"), F.count("*").alias("n"))
    above = F.col("n") * (exact("p_retailprice") - 40) > F.col("total")
    return read("part").join(brands, "p_brand").where(above).select("p_partkey", "p_brand", "p_retailprice")


@query("""
SELECT r_name, n_name, count(*) AS customers, sum(c_acctbal::DECIMAL(12,2))::DOUBLE AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def balance_rollup(read, spark, folder):
    """Customers and balances by region and nation with totals."""
    joined = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), money(F.sum(exact("c_acctbal"))).alias("balance"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(read, spark, folder):
    """Orders by status and priority with all totals."""
    return read("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type, p_size), ())")
def parts_grouping_sets(read, spark, folder):
    """Parts by several groupings in one pass."""
    p = read("part")
    return p.groupingSets([[p.p_brand], [p.p_type, p.p_size], []], p.p_brand, p.p_type, p.p_size).agg(F.count("*").alias("n"))


@query("""
WITH cents AS (SELECT *, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
       round(sqrt(((count(*) * sum(c::HUGEINT * c) - sum(c)::HUGEINT * sum(c)) // (count(*) * (count(*) - 1)))::DOUBLE)) / 100.0::DOUBLE AS deviation, quantile_cont(c, 0.5) / 100.0::DOUBLE AS median FROM cents GROUP BY ALL""")
def order_statistics(read, spark, folder):
    """Distinct counts, extremes, deviation (of whole cents, exactly summed) and exact median, none of which brings a group's values together."""
    orders = read("orders").select("o_orderpriority", "o_custkey", "o_orderdate", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    c, n = F.col("cents").cast("decimal(14,0)"), F.count("*").cast("decimal(10,0)")
    total = F.sum(c).cast("decimal(18,0)")
    variance = F.call_function("div", n * F.sum(c * c).cast("decimal(27,0)") - total * total, n * (n - 1))
    stats = orders.groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderdate").alias("days"), F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"),
        (F.round(F.sqrt(variance.cast("double"))) / 100).alias("deviation"))
    median = quantiles(orders, ["o_orderpriority"], "cents", [0.5]).select("o_orderpriority", (F.col("quantile") / 100).alias("median"))
    return stats.join(F.broadcast(median), "o_orderpriority")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def users_by_event(read, spark, folder):
    """Distinct users where one type may hold most events."""
    return distinct_by_parts(read("events"), ["event_type"], "user_id", "users")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_orders(read, spark, folder):
    """Each customer's three dearest orders."""
    return top_per_group(read("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""
SELECT o_custkey, o_orderkey, (sum(o_totalprice::DECIMAL(12,2)) OVER w)::DOUBLE AS running, (sum(o_totalprice::DECIMAL(12,2)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::DOUBLE AS moving,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS by_priority, ntile(4) OVER w AS quarter, percent_rank() OVER w AS part
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_windows(read, spark, folder):
    """Running sum, moving sum, rank, quartile and relative rank of a customer's orders."""
    price = F.round(F.col("o_totalprice") * 100).cast("bigint")  # in cents
    orders = read("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", price.alias("cents"))
    sums = {"running": running_sum(F.col("cents")), "moving": moving_sum(F.col("cents"), 2), "quarter": ntile(4), "part": percent_rank()}
    rows = ordered(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], sums)
    rows = ordered(rows, ["o_custkey"], ["o_orderpriority"], {"by_priority": rank()})
    return rows.select("o_custkey", "o_orderkey", (F.col("running") / 100).alias("running"), (F.col("moving") / 100).alias("moving"), "by_priority", "quarter", "part")


@query("""
SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after, first_value(event_id) OVER w AS first_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_neighbours(read, spark, folder):
    """What a user did before and after."""
    events = read("events").select("event_id", "event_type", "user_id", "ts")
    found = {"before": lag("event_type"), "after": lead("event_type", 2, "none"), "first_id": first("event_id")}
    return ordered(events, ["user_id"], ["ts", "event_id"], found).select("event_id", *found)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 20 FROM supplier")
def nations_union(read, spark, folder):
    return read("customer").select(F.col("c_nationkey").alias("k")).union(read("supplier").select(F.col("s_nationkey") + 20)).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def customers_intersect(read, spark, folder):
    of = lambda s: read("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("P"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def customers_except_all(read, spark, folder):
    of = lambda s: read("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").exceptAll(of("O"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY ALL""")
def status_pivot(read, spark, folder):
    return read("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


@query("""
SELECT s_suppkey, 'balance' AS measure, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier""")
def supplier_unpivot(read, spark, folder):
    s = read("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "measure", "value")


@query("""
SELECT label, count(*) AS n, sum(len([x FOR x IN embedding IF x > 0]))::BIGINT AS above, sum(list_position(embedding, list_max(embedding)))::BIGINT AS peaks FROM embeddings GROUP BY ALL""")
def embedding_signs(read, spark, folder):
    """How many elements of arrays are positive, and where their greatest stand, by label."""
    return read("embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.size(F.filter("embedding", lambda x: x > 0))).alias("above"), F.sum(F.array_position("embedding", F.array_max("embedding"))).alias("peaks"))


@query("""
SELECT a.role, b.role AS answered_by, count(*) AS n, sum(strlen(b.text))::BIGINT AS bytes
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY ALL""")
def turn_pairs(read, spark, folder):
    """Who answers whom: turns beside the next ones, by an equality of both keys, so that a long conversation is spread as well."""
    turns = read("conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("answered_by"), F.octet_length("text").alias("bytes"))
    return turns.select("conv_id", "turn", "role").join(following, ["conv_id", "turn"], "left").groupBy("role", "answered_by").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("""
SELECT strlen(word) AS size, count(*) AS n, count(DISTINCT word) AS kinds FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY ALL""")
def benchmark_words(read, spark, folder):
    """Words by their length: rows made from arrays, counted in two steps."""
    words = read("benchmark").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(F.octet_length("word").cast("bigint").alias("size")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, sum(value::DECIMAL(12,2))::DOUBLE AS total FROM events GROUP BY ALL")
def event_properties(read, spark, folder):
    """Events by a field of a JSON column."""
    return read("events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), money(F.sum(exact("value"))).alias("total"))


@query("""
SELECT p_partkey, upper(p_name) AS shout, substr(p_brand, 7) AS number, regexp_extract(p_name, '([a-z]+)$', 1) AS last_word, length(p_name) AS size,
       replace(p_type, 'O', '0') AS masked, p_name LIKE '%a%' AS has_a FROM part""")
def part_strings(read, spark, folder):
    return read("part").select(
        "p_partkey", F.upper("p_name").alias("shout"), F.substring("p_brand", 7, 100).alias("number"), F.regexp_extract("p_name", "([a-z]+)$", 1).alias("last_word"),
        F.length("p_name").alias("size"), F.replace("p_type", F.lit("O"), F.lit("0")).alias("masked"), F.col("p_name").like("%a%").alias("has_a"))


@query("""
SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, count(*) AS n, strftime(max(o_orderdate + INTERVAL 1 MONTH), '%Y-%m-%d') AS latest FROM orders GROUP BY ALL""")
def order_calendar(read, spark, folder):
    d = F.col("o_orderdate")
    return read("orders").groupBy(F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m")).agg(F.count("*").alias("n"), day(F.max(d + F.expr("INTERVAL 1 MONTH"))).alias("latest"))


@query("""
SELECT user_id, session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began FROM (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events)) GROUP BY ALL""")
def user_sessions(read, spark, folder):
    """Sessions of users, parted by pauses of half an hour."""
    s = sessions(read("events"), ["user_id"], "ts", 1800)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), moment(F.min("ts")).alias("began"))


@query("""
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS began, event_type, count(*) AS n, ((200 * sum(round(value * 100)::BIGINT) + count(value)) // (2 * count(value))) / 10000.0::DOUBLE AS mean FROM events GROUP BY ALL""")
def tumbling_windows(read, spark, folder):
    rows = read("events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), mean("value", 4).alias("mean"))
    return rows.select(moment("window.start").alias("began"), "event_type", "n", "mean")


@query("""
SELECT strftime(began, '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM (
  SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS began FROM events) GROUP BY ALL""")
def sliding_windows(read, spark, folder):
    rows = read("events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return rows.select(moment("window.start").alias("began"), "n")


@query("""
SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON true""")
def click_before_purchase(read, spark, folder):
    """Each purchase with its user's latest click until then (as-of join)."""
    e = read("events").select("event_id", "user_id", "ts", "event_type")
    of = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    return asof_join(of("purchase"), of("click"), ["user_id"], "ts", "ts", {"event_id": "click_id"}, "event_id").select("event_id", "click_id")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 2.5 AND s_acctbal + 2.5")
def like_balances(read, spark, folder):
    """Customers and suppliers of nearly one balance (range join)."""
    low, high = F.col("s_acctbal") - 2.5, F.col("s_acctbal") + 2.5
    return range_join(read("customer").select("c_custkey", "c_acctbal"), read("supplier").select("s_suppkey", "s_acctbal"), F.col("c_acctbal"), low, high, 5.0).select("c_custkey", "s_suppkey")


@query("""
WITH runs AS (
  SELECT user_id, event_type, grp, min(ts) AS first_ts, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), min(event_id)) AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS grp FROM events)
  GROUP BY user_id, event_type, grp)
SELECT v.user_id, v.first_id, p.first_id AS last_id, v.n + c.n + 1 AS n FROM runs v JOIN runs c ON c.user_id = v.user_id AND c.run = v.run + 1 JOIN runs p ON p.user_id = v.user_id AND p.run = v.run + 2
WHERE v.event_type = 'view' AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.first_ts - v.first_ts <= INTERVAL 2 DAY""")
def views_to_purchases(read, spark, folder):
    """Stretches of a user's events that are views, then clicks, then a purchase, within two days."""
    events = read("events").select("user_id", "ts", "event_id", "event_type")
    found = matches(events, ["user_id"], ["ts", "event_id"], "event_type", [("view", True), ("click", True), ("purchase", False)])
    return found.where(F.col("last.ts") - F.col("first.ts") <= F.expr("INTERVAL 2 DAYS")).select("user_id", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "n")


@query("""
WITH numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS starts FROM events)
), visits AS (SELECT user_id, session, min(ts) AS began, max(ts) AS ended FROM numbered GROUP BY user_id, session
), gaps AS (SELECT user_id, event_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'purchase')
SELECT v.user_id, session, event_id FROM visits v JOIN gaps g ON v.user_id = g.user_id AND began <= until AND since <= ended""")
def visits_between_purchases(read, spark, folder):
    """A user's visits and the spans between two purchases, where they overlap; widths go from nothing to weeks."""
    events = read("events").select("user_id", "event_id", "ts", "event_type")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    visits = sessions(events, ["user_id"], "ts", 10_800).groupBy("user_id", "session").agg(F.min(micros("ts")).alias("began"), F.max(micros("ts")).alias("ended"))
    gaps = ordered(events.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], {"until": lead("ts")})
    gaps = gaps.select("user_id", "event_id", micros("ts").alias("since"), micros("until").alias("until"))
    return overlap_join(visits, gaps, ["user_id"], ("began", "ended"), ("since", "until")).select("user_id", "session", "event_id")


@query("""
SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT + CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 100 ELSE 0 END AS cents FROM orders WHERE o_orderstatus != 'P'""")
def merged_orders(read, spark, folder):
    """A table of early orders into which two lots of changes are merged: later orders and deletions, then dearer ones."""
    orders = read("orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    columns, early = ["o_orderkey", "o_custkey", "cents"], F.col("o_orderdate") < ntz("2000-01-01")
    root, gone = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", F.col("o_orderstatus") == "P"
    keyed.create(orders.where(early).select(*columns), root, "o_orderkey", 100_000)
    keyed.merge(root, orders.where(~early | gone).select(*columns, gone.alias("gone")), "later and gone", "gone", 100_000)
    dearer = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    keyed.merge(root, dearer.select("o_orderkey", "o_custkey", (F.col("cents") + 100).alias("cents"), F.lit(False).alias("gone")), "dearer", "gone", 100_000)
    keyed.vacuum(spark, root)
    return keyed.read(spark, root)


@query("""
SELECT p_partkey, p_retailprice, p_size FROM part p
WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_retailprice <= p.p_retailprice AND o.p_size >= p.p_size AND (o.p_retailprice < p.p_retailprice OR o.p_size > p.p_size))""")
def best_parts(read, spark, folder):
    """Parts that no other part undercuts in price and exceeds in size (skyline)."""
    return skyline(read("part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice"], ["p_size"])


@query("""
WITH words AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) * 200 > (SELECT count(*) FROM words)""")
def frequent_words(read, spark, folder):
    """Words that are more than one of 200 words of all documents: candidates from a summary of bounded size, then exact counts."""
    words = read("documents").select(F.explode(F.split("text", " ")).alias("word"))
    return frequent_values(words, F.col("word"), 200).withColumnRenamed("value", "word")


@query(None)
def event_summaries(read, spark, folder):
    """Users and median value by event type, estimated from sketches by day and type, merged; the errors are tested."""
    daily = written(summaries(read("events").select(F.to_date("ts").alias("day"), "event_type", "user_id", F.round(F.col("value") * 100).alias("cents")), ["day", "event_type"], "user_id", "cents"), "event-summaries")
    found = estimates(merged(daily, ["event_type"]), [0.5])
    return found.select("event_type", "n", F.col("distinct").alias("users"), (F.col("quantiles")[0] / 100).alias("median"))


@query("SELECT p_type, count(*) AS n, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def quantity_by_type(read, spark, folder):
    """A join whose keys may be very uneven."""
    items, parts = read("lineitem").select("l_partkey", "l_quantity"), read("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return uneven_join(items, parts, ["l_partkey"]).groupBy("p_type").agg(F.count("*").alias("n"), money(F.sum(exact("l_quantity"))).alias("quantity"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS began, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(read, spark, folder):
    """Windowed counts as a stream with a watermark, run over what is there."""
    found = run_all(counts_by_window(events(spark, f"{folder}/events.parquet"), "ts", "1 day", "2 days", ["event_type"]), "update", ["window", "event_type"])
    return found.select(moment("window.start").alias("began"), "event_type", "n")


@query("""
WITH seen AS (
  SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events
) SELECT user_id, event_type, count(*) AS n FROM seen WHERE before IS NULL GROUP BY ALL""")
def stream_first_seen(read, spark, folder):
    """The first event of each user and type, from a stream of several batches; n counts what the stream emits, so that a repeat would show."""
    rows = in_batches(read("events").select("event_id", "user_id", "event_type", "ts"), "ts", 3)
    return emitted(without_repeats(rows, "ts", "60 days", ["user_id", "event_type"])).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""
WITH numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events)
), whole AS (
  SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM numbered GROUP BY user_id, session)
SELECT user_id, strftime(began, '%Y-%m-%d %H:%M:%S') AS began, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, n
FROM whole WHERE ended + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_user_sessions(read, spark, folder):
    """Sessions of users as a stream of several batches, with state and timers: those that are closed two hours before the last event."""
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", STORE):
        found = emitted(stream_sessions(in_batches(read("events").select("user_id", "ts"), "ts", 4), "user_id", "ts", 1800, "2 hours"))
    return found.select("user_id", moment("began").alias("began"), moment("ended").alias("ended"), "n")


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts FROM events WHERE event_type = 'click'),
mark AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM c)) - INTERVAL 10 MINUTE AS last_mark)
SELECT event_id, click_id FROM p JOIN c ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts
UNION ALL SELECT event_id, NULL FROM p WHERE ts < (SELECT last_mark FROM mark) AND NOT EXISTS (SELECT 1 FROM c WHERE p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts)""")
def stream_clicks_of_purchases(read, spark, folder):
    """Purchases with the clicks of the hour before, of two streams; those without one when the watermark has passed them."""
    rows = read("events").select("event_id", "user_id", "event_type", "ts")
    of = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    purchases = in_batches(of("purchase"), "ts", 3)
    clicks = in_batches(of("click").withColumnsRenamed({"event_id": "click_id", "ts": "clicked"}), "clicked", 3)
    return emitted(interval_join(purchases, clicks, ["user_id"], "ts", "clicked", 3600, "10 minutes")).select("event_id", "click_id")


@query(None)
def nearest_vectors(read, spark, folder):
    """The ten nearest of all embeddings to each whose id is divisible by 50, by an inverted file of cells; its recall is measured in the tests."""
    rows = usable(read("embeddings"), "vec_id", "embedding", 64)
    found = nearest(rows, rows.where("id % 50 = 0"), 10)
    return found.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("distance", 4).alias("distance"))


@query("""
SELECT vec_id, rank, neighbour, round(distance, 4) AS distance FROM (
  SELECT q.vec_id, n.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, n.vec_id) AS rank
  FROM embeddings q JOIN embeddings n ON q.vec_id % 50 = 0 AND n.vec_id != q.vec_id) WHERE rank <= 10""")
def nearest_vectors_exact(read, spark, folder):
    """The same, looking into all cells."""
    rows = usable(read("embeddings"), "vec_id", "embedding", 64)
    found = nearest(rows, rows.where("id % 50 = 0"), 10, exact=True)
    return found.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("distance", 4).alias("distance"))
