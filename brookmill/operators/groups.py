"""Ranking within groups, sessions and sums of hot groups."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.functions.columns import place_among
from brookmill.sources.written import written

#: Rows to a piece of time, and the most pieces; beyond that they hold more rows, with the same result.
PIECE_ROWS, MOST_PIECES = 5_000_000, 10_000
#: Size of the sketch of times from which the bounds come: they err by 0.04 % of all rows; and how many tasks merge the sketches of all others.
BOUNDS_K, BOUNDS_TASKS = 1 << 14, 64


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in the given order, numbered from 1. Spark
    drops rows beyond n before the shuffle as well."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def cut(df: DataFrame, time: str, pieces: int | None = None, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, int]:
    """df with `piece`, the number of the stretch of time that a row falls into, and how many there are.

    There is a piece for each piece_rows rows of df unless `pieces` says
    otherwise; their bounds are quantiles of all times, MOST_PIECES at most. df
    is read once: the number of rows and a sketch of the times come together.
    """
    micros = micros_of(df, time)
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(BOUNDS_TASKS)).alias("part")).agg(
        F.count("*").alias("n"), F.count(micros).alias("known"), F.kll_sketch_agg_bigint(micros, BOUNDS_K).alias("sketch"))
    found = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("known").alias("known"), F.kll_merge_agg_bigint("sketch", BOUNDS_K).alias("sketch")).first()
    pieces = min(pieces or 1 + found["n"] // piece_rows, MOST_PIECES)
    if pieces == 1:
        return df.withColumn("piece", F.lit(0)), 1
    bounds: list[int] = []
    if found["known"]:
        shares = F.lit([k / pieces for k in range(1, pieces)])
        bounds = df.sparkSession.range(1).select(F.kll_sketch_get_quantile_bigint(F.lit(bytes(found["sketch"])), shares).alias("bounds")).first()["bounds"]
    known = F.from_json(F.lit(json.dumps(sorted(set(bounds)))), "array<bigint>")
    return df.withColumn("piece", place_among(known, micros, pieces)), pieces


def micros_of(df: DataFrame, time: str) -> Column:
    """A time, date or whole number as a whole number in the same order."""
    return F.col(time).cast("bigint") if df.schema[time].dataType.typeName() in ("byte", "short", "integer", "long") else F.unix_micros(F.col(time).cast("timestamp"))


def sessions(df: DataFrame, by: list[str], time: str, gap_seconds: int, name: str = "session", pieces: int | None = None) -> DataFrame:
    """df with the number, from 1, of each row's session: a pause of more than
    gap_seconds begins a new one.

    Rows are looked at by `by` columns and piece of time (see cut); the last
    time and the number of sessions of the pieces before are carried into each
    piece, so one key may hold most rows. With several pieces their rows are
    written once and read from there. A row with a null time or a null key has
    no session.
    """
    columns = df.columns
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    usable = functools.reduce(lambda x, c: x & F.col(c).isNotNull(), by, F.col(time).isNotNull())
    rows, pieces = cut(df.where(usable).withColumn("session_at", seconds), "session_at", pieces)
    order = W.partitionBy(*by, "piece").orderBy("session_at")
    before = W.partitionBy(*by).orderBy("piece")
    rows = rows.withColumn("session_last", F.lag("session_at").over(order))
    if pieces > 1:
        rows = written(rows, "session-rows")
        ends = rows.groupBy(*by, "piece").agg(F.max("session_at").alias("end"))
        ends = ends.select(*by, "piece", F.lag("end").over(before).alias("session_end"))
        rows = rows.join(ends, [*by, "piece"]).withColumn("session_last", F.coalesce("session_last", "session_end"))
    pause = F.col("session_at") - F.col("session_last")
    rows = rows.withColumn("session_starts", F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0))
    number = F.sum("session_starts").over(order)
    if pieces > 1:
        begun = rows.groupBy(*by, "piece").agg(F.sum("session_starts").alias("n"))
        begun = begun.select(*by, "piece", F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("session_before"))
        rows, number = rows.join(begun, [*by, "piece"]), number + F.col("session_before")
    return rows.withColumn(name, number).select(*columns, name).unionByName(df.where(~F.coalesce(usable, F.lit(False))).withColumn(name, F.lit(None).cast("bigint")))


def distinct_by_parts(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Exact numbers of distinct values where one group may hold most rows: values
    are made distinct over all tasks first, then counted with partial sums."""
    return df.select(*by, column).where(F.col(column).isNotNull()).distinct().groupBy(*by).agg(F.count("*").alias(name))
