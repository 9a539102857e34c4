"""Joins that need more than an equality of keys."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from brookmill.operators.groups import cut
from brookmill.sources.written import written

#: Most bytes of a table that a join may broadcast.
BROADCAST_BYTES = 64_000_000


def size_in_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a table take: lengths of strings and of what is nested, 8 for all else, 16 a value besides."""
    long = lambda f: F.octet_length(F.col(f.name) if f.dataType.typeName() in ("string", "binary") else F.to_json(F.struct(F.col(f.name))))
    sized = [F.coalesce(long(f), F.lit(0)) + 16 if f.dataType.typeName() in ("string", "binary", "array", "map", "struct") else F.lit(24) for f in df.schema.fields]
    return df.agg(F.sum(functools.reduce(lambda a, b: a + b, sized, F.lit(16)).cast("long"))).first()[0] or 0


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: dict[str, str], tie: str | None = None, pieces: int | None = None,
) -> DataFrame:
    """Each row of left with `values` (right column: new name) of the latest row of
    right with equal `by` columns and a time before or at its own; nulls if none.

    Both sides are united and looked at in time order, by `by` columns and piece
    of time; the last row of the pieces before is carried into each piece. So a
    key with most rows is spread over as many tasks as there are pieces: one for
    each PIECE_ROWS rows, cut at quantiles of all times and written once. Of right rows of one
    time the greatest `tie` counts. Rows with a null time or key find nothing
    and do not take part.
    """
    usable = lambda df, time: functools.reduce(lambda x, c: x & F.col(c).isNotNull(), by, F.col(time).isNotNull())
    order = F.struct(F.col(right_time).alias("time"), F.col(tie or right_time).alias("tie"))
    found = F.struct(*[F.col(c).alias(name) for c, name in values.items()]).alias("found")
    theirs = right.where(usable(right, right_time)).select(*by, F.col(right_time).alias("asof_time"), F.struct(order.alias("order"), found).alias("asof_right"), F.lit(None).alias("asof_left"))
    ours = left.where(usable(left, left_time)).select(*by, F.col(left_time).alias("asof_time"), F.lit(None).alias("asof_right"), F.struct(*left.columns).alias("asof_left"))
    alone = left.where(~F.coalesce(usable(left, left_time), F.lit(False)))
    rows, pieces = cut(theirs.unionByName(ours), "asof_time", pieces)
    if pieces > 1:
        rows = written(rows, "asof-rows")
    latest = lambda over: F.max_by(F.col("asof_right"), F.col("asof_right.order")).over(over)
    within = W.partitionBy(*by, "piece").orderBy("asof_time").rangeBetween(W.unboundedPreceding, W.currentRow)
    known = rows.withColumn("asof_known", latest(within)).where(F.col("asof_left").isNotNull())
    if pieces > 1:
        ends = rows.groupBy(*by, "piece").agg(F.max_by("asof_right", "asof_right.order").alias("asof_right"))
        carried = ends.select(*by, "piece", latest(W.partitionBy(*by).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)).alias("asof_carried"))
        known = known.join(carried, [*by, "piece"]).withColumn("asof_known", F.coalesce("asof_known", "asof_carried"))
    out = known.select("asof_left.*", *[F.col(f"asof_known.found.{name}").alias(name) for name in values.values()])
    kinds = {name: right.schema[c].dataType for c, name in values.items()}
    return out.unionByName(alone.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]))


def range_join(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs of a point and a range with low <= at <= high.

    The line is cut into cells of `width`; a range is copied to each cell that
    it touches, so the join is one on equal cells. Choose a width near that of
    usual ranges: much smaller ones copy more, much greater ones compare more.
    """
    cell = lambda c: F.floor(c / F.lit(float(width)))
    dealt = ranges.where(low <= high).withColumn("range_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("range_cell", cell(at)).join(dealt, "range_cell").where((at >= low) & (at <= high)).drop("range_cell")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of a row of left and one of right with equal `by` columns whose ranges of whole numbers, ends included, overlap.

    Columns of the two have to differ but for `by`. Widths may differ by any
    factor: a range belongs to the level of the least power of two above its
    width, where it touches two cells of that size at most, and meets others at
    the level of the wider one. So each row is stored twice at most, and looked
    up in two cells of each level that the other side has, some 60 at most. Of
    two cells that a pair has in common the one in which its overlap begins
    counts. Ranges with a null end, or ends in the wrong order, overlap none.
    """
    sides = {}
    for side, df, (low, high) in (("left", left, left_range), ("right", right, right_range)):
        low, high = F.col(low).cast("bigint"), F.col(high).cast("bigint")
        level = F.when(high > low, F.length(F.bin(high - low))).otherwise(0)
        sides[side] = df.where(low <= high).withColumns({f"{side}_low": low, f"{side}_high": high, f"{side}_level": level})
    shift = lambda name, level: F.expr(f"shiftright({name}, {level})")
    cells = lambda side, level: F.explode(F.array_distinct(F.array(shift(f"{side}_low", level), shift(f"{side}_high", level)))).alias(f"{side}_cell")
    pairs = []
    for stored, asking, wider in (("right", "left", ">="), ("left", "right", ">")):
        levels = sorted(r[0] for r in sides[stored].select(f"{stored}_level").distinct().collect())  # 64 at most
        there = sides[stored].select("*", cells(stored, f"{stored}_level"))
        here = sides[asking].withColumn("ask_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).where(f"ask_level {wider} {asking}_level")
        # Spark guesses sizes without the copies that explode makes, and would send them all to the driver to broadcast them
        here = here.select("*", cells(asking, "ask_level")).hint("merge")
        on = (F.col("ask_level") == F.col(f"{stored}_level")) & (F.col(f"{asking}_cell") == F.col(f"{stored}_cell"))
        on = functools.reduce(lambda a, c: a & (here[c] == there[c]), by, on)
        meet = (F.col("left_low") <= F.col("right_high")) & (F.col("right_low") <= F.col("left_high"))
        begins = F.expr(f"shiftright(greatest(left_low, right_low), {stored}_level)") == F.col(f"{stored}_cell")
        found = here.join(there, on & meet & begins)
        pairs.append(found.select(*[here[c] for c in by], *[c for df in (left, right) for c in df.columns if c not in by]))
    return pairs[0].unionByName(pairs[1])


def uneven_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A join whose keys may hold very many rows of big: small is broadcast where
    its rows take at most `most_bytes`; beyond that both sides are shuffled, and
    Spark splits the partitions of hot keys (adaptive skew joins), equal rows
    included. small is read once to be measured, so it should be a table."""
    return big.join(F.broadcast(small) if size_in_bytes(small) <= most_bytes else small, on, how)
