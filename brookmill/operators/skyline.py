"""Rows that no other row dominates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.sources.written import passing, written

#: Rows that are compared with rows at a time, and candidates to a block, about.
STEP, BLOCK = 1024, 4096


def undominated(points: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """Which points no point of `held` (by default, of themselves) dominates: is nowhere greater and somewhere less."""
    if held is not None:
        keep = np.ones(len(points), bool)
        for at in range(0, len(held), STEP):
            for k in range(0, len(points), STEP):
                some, part = held[None, at : at + STEP], points[k : k + STEP, None]
                keep[k : k + STEP] &= ~((some <= part).all(2) & (some < part).any(2)).any(1)
        return keep
    # only a row of a lesser sum can dominate, or one whose sum was rounded to the same
    order = np.lexsort((*points.T, points.sum(1)))
    keep, front = np.zeros(len(points), bool), np.zeros((0, points.shape[1]))
    for at in range(0, len(order), STEP):
        some = order[at : at + STEP]
        some = some[undominated(points[some], front)]
        some = some[undominated(points[some], points[some])]
        if len(front):
            front = front[undominated(front, points[some])]
        keep[some] = True
        front = np.concatenate([front, points[some]])
    kept = np.flatnonzero(keep)
    keep[kept] = undominated(points[kept], front)
    return keep


def skyline(df: DataFrame, least: list[str], most: list[str]) -> DataFrame:
    """A written table of the rows of df that no row dominates: none is as good in all of the columns and better in one.

    Of `least` columns less is better, of `most` more; they are compared as
    doubles. Rows with a null or NaN in one of them are left out; equal rows stay
    together. Each task drops what its own rows dominate. What is left is dealt
    into blocks, every block is compared with every block, and a row stays that
    no block dominates; the number of blocks grows with what the tasks left,
    not with the table.
    """
    names = [*least, *most]
    sign = [1.0] * len(least) + [-1.0] * len(most)
    usable = df
    for c in names:
        usable = usable.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    point = F.array(*[F.col(c).cast("double") * s for c, s in zip(names, sign)])

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            held = held.filter(pa.array(undominated(matrix(held.column("sky_point")))))
        yield from held.to_batches() if held is not None else []

    def compare(here: pa.Table, there: pa.Table) -> pa.Table:
        lost = ~undominated(matrix(here.column("sky_point")), matrix(there.column("sky_point"))) if here.num_rows and there.num_rows else np.zeros(here.num_rows, bool)
        return pa.table({"sky_row": here.column("sky_row").filter(pa.array(lost)).cast(pa.int64())})

    with passing() as tables:
        rows = usable.withColumn("sky_point", point)
        found = written(rows.mapInArrow(local, rows.schema).withColumn("sky_row", F.monotonically_increasing_id()), "sky-found")
        blocks = 1 + found.count() // BLOCK
        placed = found.select("sky_row", "sky_point", F.pmod(F.xxhash64("sky_row"), F.lit(blocks)).cast("int").alias("own"))
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        here, there = placed.withColumn("other", every), placed.withColumnRenamed("own", "other").withColumn("own", every)
        lost = here.groupBy("own", "other").cogroup(there.groupBy("own", "other")).applyInArrow(compare, "sky_row bigint").distinct()
        out = written(found.join(lost, "sky_row", "left_anti").select(*df.columns), "skyline")
        tables.keep(out)
    return out
