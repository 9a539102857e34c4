"""Joins of two streams by key and distance in time."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, within_seconds: int, late: str) -> DataFrame:
    """Each row of the stream left with each row of the stream right that has equal `by` columns and a
    time at or up to within_seconds before its own; with nulls if there is none.

    Columns of the two have to differ but for `by`. Pairs are emitted when both
    rows are there, rows without one when the watermark says that none can come.
    State is bounded by the interval and `late`: a row goes when the watermark
    has passed its last possible partner. Rows are dealt by key and stretch of
    time: a right row goes to its own stretch and the next, as long as the
    interval each, so a key with most rows is spread over time. A left row with
    a null key or time is left out, as it would never be emitted.
    """
    length = within_seconds * 1_000_000
    stretch = lambda time: F.floor(F.unix_micros(time) / F.lit(length))
    ours = left.where(functools.reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.col(left_time).isNotNull()))
    ours = ours.withWatermark(left_time, late).withColumn("stretch", stretch(F.col(left_time)))
    names = {c: f"right_{c}" for c in by}
    theirs = right.withColumnsRenamed(names).withWatermark(right_time, late)
    theirs = theirs.withColumn("right_stretch", F.explode(F.array(stretch(F.col(right_time)), stretch(F.col(right_time)) + 1)))
    span = F.expr(f"INTERVAL {within_seconds} SECONDS")
    near = (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - span)
    on = functools.reduce(lambda a, c: a & (F.col(c) == F.col(names[c])), by, F.col("stretch") == F.col("right_stretch"))
    return ours.join(theirs, on & near, "left_outer").drop("stretch", "right_stretch", *names.values())
