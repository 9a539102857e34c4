"""Patterns of successive rows within groups that may hold most rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.operators.scans import lag, lead, ordered, row_number


def runs(df: DataFrame, by: list[str], order: list[str], kind: str, pieces: int | None = None) -> DataFrame:
    """The longest runs of successive rows of one kind: the `by` columns, run_kind, run_first and run_last
    (structs of order), run_n. Nulls are a kind."""
    rows = df.select(*by, *order, F.col(kind).alias("run_kind"), F.lit(1).alias("run_one"))
    rows = ordered(rows, by, order, {"run_before": lag("run_kind"), "run_after": lead("run_kind"), "run_at": row_number(), "run_prior": lag("run_one"), "run_next": lead("run_one")}, pieces)
    opens = F.col("run_prior").isNull() | ~F.col("run_before").eqNullSafe(F.col("run_kind"))
    closes = F.col("run_next").isNull() | ~F.col("run_after").eqNullSafe(F.col("run_kind"))
    edges = rows.where(opens | closes).select(*by, *order, "run_kind", "run_at", opens.alias("run_opens"), closes.alias("run_closes"), F.struct(*order).alias("run_here"))
    edges = ordered(edges, by, order, {"run_end": lead("run_here"), "run_end_at": lead("run_at")}, pieces)
    alone = F.col("run_closes")
    return edges.where("run_opens").select(
        *by, "run_kind", F.col("run_here").alias("run_first"), F.when(alone, F.col("run_here")).otherwise(F.col("run_end")).alias("run_last"),
        (F.when(alone, F.col("run_at")).otherwise(F.col("run_end_at")) - F.col("run_at") + 1).cast("bigint").alias("run_n"))


def matches(df: DataFrame, by: list[str], order: list[str], kind: str, steps: list[tuple[str, bool]], pieces: int | None = None) -> DataFrame:
    """The longest stretches of successive rows of a group whose kinds are those of steps in turn: one row of
    the kind or, where a step says True, one or more. The `by` columns, first and last (structs of order), n (rows).

    Kinds of neighbouring steps have to differ, so that runs of one kind are
    what steps take: a first step of one row takes the last of its run, a last
    step of one row the first, a step between them needs a run of one row.
    Rows are looked at in even pieces, and neighbouring runs are carried over
    their bounds, so a group may hold most rows. Stretches of one pattern may
    share a row only where its first and last kinds are equal.
    """
    names = [k for k, _ in steps]
    if len(steps) < 2 or any(a == b for a, b in zip(names, names[1:])):
        raise ValueError("steps have to be two or more, with different kinds one after the other")
    found = runs(df, by, order, kind, pieces).select("*", *[F.col(f"run_first.{c}").alias(f"run_by_{k}") for k, c in enumerate(order)])
    whole = F.struct("run_kind", "run_first", "run_last", "run_n")
    found = ordered(found.withColumn("run", whole), by, [f"run_by_{k}" for k in range(len(order))], {f"run_{i}": lag("run", i) for i in range(1, len(steps))}, pieces)
    step = lambda i: F.col("run") if i == len(steps) - 1 else F.col(f"run_{len(steps) - 1 - i}")
    inner = range(1, len(steps) - 1)
    fits = functools.reduce(lambda a, b: a & b, [step(i)["run_kind"] == k for i, k in enumerate(names)] + [step(i)["run_n"] == 1 for i in inner if not steps[i][1]])
    n = functools.reduce(lambda a, b: a + b, [step(i)["run_n"] for i in inner], F.lit(0).cast("bigint"))
    edge = lambda i: step(i)["run_n"] if steps[i][1] else F.lit(1)
    first = step(0)["run_first"] if steps[0][1] else step(0)["run_last"]
    last = step(len(steps) - 1)["run_last"] if steps[-1][1] else step(len(steps) - 1)["run_first"]
    return found.where(fits).select(*by, first.alias("first"), last.alias("last"), (n + edge(0) + edge(len(steps) - 1)).alias("n"))
