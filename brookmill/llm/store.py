"""Intermediate tables, joins with a checked size, and columns set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.operators.joins import size_in_bytes
from brookmill.sources.written import discard, passing, written

__all__ = ["BROADCAST_BYTES", "discard", "join_checked", "passing", "set_apart", "written"]

#: Most bytes of rows that a join may broadcast; a query has three such joins at a time at most.
BROADCAST_BYTES = 32_000_000


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is broadcast where its rows take at most most_bytes, shuffled beyond.

    The side is read to be measured, so it should be a written table.
    """
    return big.join(F.broadcast(small) if size_in_bytes(small) <= most_bytes else small, on, how)


def set_apart(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones under names that no operator uses, and the way back to docs' own columns."""
    names = {c: c if c in needed else f"carried_{k}" for k, c in enumerate(docs.columns)}
    there = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return there, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])
