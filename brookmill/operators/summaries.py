"""Summaries of bounded size that can be stored and merged: distinct values, quantiles, heavy hitters.

Distinct values and quantiles are Spark's own sketches, kept as binary columns.
Heavy hitters are counters that err by a known amount: each task, then each
merge, keeps at most `size` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.sources.written import passing, written

#: Log2 of the registers of a sketch of distinct values (relative error about 1.04 / sqrt(2^n)), and the size of a sketch of quantiles (rank error about 1 %).
DISTINCT_LOG2, QUANTILE_K = 12, 400


def summaries(df: DataFrame, by: list[str], distinct: str | None = None, quantile: str | None = None) -> DataFrame:
    """The `by` columns, n, and the sketches distinct_sketch of one column and quantile_sketch of another, a whole number; a few KB a row.

    Nulls don't count in sketches. The rows can be written, and merged at any time.
    """
    found = [F.count("*").alias("n")]
    if distinct:
        found.append(F.hll_sketch_agg(distinct, DISTINCT_LOG2).alias("distinct_sketch"))
    if quantile:
        found.append(F.kll_sketch_agg_bigint(F.col(quantile).cast("bigint"), QUANTILE_K).alias("quantile_sketch"))
    return df.groupBy(*by).agg(*found)


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows of summaries() brought together by fewer columns."""
    found = [F.sum("n").alias("n")]
    if "distinct_sketch" in table.columns:
        found.append(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    if "quantile_sketch" in table.columns:
        found.append(F.kll_merge_agg_bigint("quantile_sketch", QUANTILE_K).alias("quantile_sketch"))
    return table.groupBy(*by).agg(*found)


def estimates(table: DataFrame, shares: list[float] = ()) -> DataFrame:
    """Sketches as numbers: `distinct`, and `quantiles` for each share."""
    out = table
    if "distinct_sketch" in table.columns:
        out = out.withColumn("distinct", F.hll_sketch_estimate("distinct_sketch"))
    if "quantile_sketch" in table.columns:
        out = out.withColumn("quantiles", F.array(*[F.kll_sketch_get_quantile_bigint("quantile_sketch", F.lit(float(s))) for s in shares]))
    return out.drop("distinct_sketch", "quantile_sketch")


def _reduced(counts: dict, size: int) -> int:
    """Take the (size + 1)-th greatest count from all, in place, and drop what is used up; how much was taken."""
    if len(counts) <= size:
        return 0
    cut = sorted(counts.values(), reverse=True)[size]
    for key in [k for k, n in counts.items() if n <= cut]:
        del counts[key]
    for key in counts:
        counts[key] -= cut
    return cut


def heavy_hitters(df: DataFrame, value: Column, size: int = 1000) -> DataFrame:
    """value (string), least, most: at most `size` values, with every one that more than 1 / size of the rows have.

    The true count is between `least` and `most`, which differ by at most
    rows / size. Each task keeps 2 * size counters at a time and sends `size`, with
    what it took from them (Misra-Gries); these are merged in as many tasks as
    there are shuffle partitions, and theirs in one. Nulls don't count.
    """

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        taken = 0
        for batch in batches:
            grouped = batch.column("value").value_counts()
            for value, n in zip(grouped.field("values").to_pylist(), grouped.field("counts").to_pylist()):
                if value is not None:
                    counts[value] = counts.get(value, 0) + n
                if len(counts) >= 2 * size:
                    taken += _reduced(counts, size)
        taken += _reduced(counts, size)
        yield _listed(counts, taken)

    def _listed(counts: dict, taken: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64())), pa.array([taken], pa.int64())], names=["vals", "counts", "taken"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        taken = 0
        for batch in batches:
            for values, ns, part in zip(*[batch.column(c).to_pylist() for c in ("vals", "counts", "taken")]):
                for value, n in zip(values, ns):
                    counts[value] = counts.get(value, 0) + n
                taken += part + _reduced(counts, size)
        yield _listed(counts, taken)

    kind = "vals array<string>, counts array<bigint>, taken bigint"
    lists = df.select(value.cast("string").alias("value")).mapInArrow(in_task, kind)
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = lists.repartition(tasks).mapInArrow(merge, kind).repartition(1).mapInArrow(merge, kind)
    return lists.select(F.explode(F.arrays_zip("vals", "counts")).alias("x"), "taken").select(F.col("x.vals").alias("value"), F.col("x.counts").alias("least"), (F.col("x.counts") + F.col("taken")).alias("most"))


def frequent_values(df: DataFrame, value: Column, one_of: int) -> DataFrame:
    """value (string) and n, its exact count, of all values that more than one of so many rows with a value have.

    A summary names the candidates, at most one_of; a second pass counts them.
    """
    rows = df.select(value.cast("string").alias("value")).where(F.col("value").isNotNull())
    with passing() as tables:
        named = written(heavy_hitters(rows, F.col("value"), one_of).select("value"), "frequent-candidates")
        marked = rows.join(F.broadcast(named.withColumn("known", F.lit(True))), "value", "left")
        counts = marked.groupBy(F.when(F.col("known"), F.col("value")).alias("value")).agg(F.count("*").alias("n"))
        counts = written(counts, "frequent-counts")  # a row for each candidate, and one for all else
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        out = written(counts.where(F.col("value").isNotNull() & (F.col("n") * one_of > total)), "frequent-values")
        tables.keep(out)
    return out
