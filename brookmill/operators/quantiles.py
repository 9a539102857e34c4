"""Exact quantiles of groups of any size, by narrowing histograms."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.operators.joins import BROADCAST_BYTES, size_in_bytes
from brookmill.sources.written import passing, written

#: Counters to a group and round; 64-bit values take seven rounds at most.
BUCKETS = 1024


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], buckets: int = BUCKETS) -> DataFrame:
    """A written table of the `by` columns, share, and quantile: a double, between the two nearest values as the share asks for.

    value is a whole number, such as cents or microseconds; nulls don't count,
    and a group without values has no row. Null keys are a group. Each round
    counts the values of a group, within the range that is still open, in
    `buckets` equal parts, and goes on with the part that holds the value
    wanted, from the least to the greatest value in it. So a group takes
    `buckets` counters for each value wanted, and its values are never brought
    together. Equal values end the search at once.
    """
    keys = {c: f"q_{k}" for k, c in enumerate(by)}
    with passing() as tables:
        rows = written(df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in keys.items()], F.col(value).cast("bigint").alias("v")), "quantile-rows")
        names = list(keys.values())
        sizes = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        at = F.col("share") * (F.col("n") - 1)
        wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        wanted = wanted.select(*names, "share", at.alias("at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"), "low", "high")
        state = written(wanted.withColumn("left", F.col("rank")), "quantile-state")
        found = [state.where("low = high")]
        while (open_ := state.where("low < high")).limit(1).count():
            state = written(_narrowed(rows, open_, names, buckets), "quantile-state")
            found.append(state.where("low = high"))
        values = functools.reduce(DataFrame.unionByName, found)
        lower, part = F.min_by("low", "rank").cast("double"), F.first("at") - F.min("rank")
        out = values.groupBy(*names, "share").agg((lower + (F.max_by("low", "rank").cast("double") - lower) * part).alias("quantile"))
        out = written(out.withColumnsRenamed({k: c for c, k in keys.items()}), "quantiles")
        tables.keep(out)
    return out


def _narrowed(rows: DataFrame, state: DataFrame, names: list[str], buckets: int) -> DataFrame:
    """state with the range narrowed to the part that holds the value wanted, and `left`, its rank within."""
    wanted = state.select(*[F.col(n).alias(f"of_{n}") for n in names], "share", "at", "rank", "low", "high", "left")
    wanted = F.broadcast(wanted) if size_in_bytes(wanted) <= BROADCAST_BYTES else wanted
    on = functools.reduce(lambda a, n: a & F.col(n).eqNullSafe(F.col(f"of_{n}")), names, (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    # the range may be wider than 64 bits
    span = (F.col("high").cast("decimal(20,0)") - F.col("low") + buckets) / F.lit(buckets)
    bucket = F.floor((F.col("v").cast("decimal(20,0)") - F.col("low")) / F.floor(span)).cast("int")
    kept = ["share", "at", "rank", "left"]
    counts = rows.join(wanted, on).groupBy(*names, *kept, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    line = W.partitionBy(*names, "share", "rank").orderBy("bucket")
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    holds = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n"))
    return counts.where(holds).withColumn("left", F.col("left") - F.col("before")).select(*names, "share", "at", "rank", "low", "high", "left")
