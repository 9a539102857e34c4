"""Column expressions used by several queries; all run inside Spark's own engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(value: str | Column, digits: int = 12) -> Column:
    """A number with two decimals as such, so that sums do not depend on their order; at most so many digits in all."""
    return (F.col(value) if isinstance(value, str) else value).cast(f"decimal({digits},2)")


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return exact(price) * (1 - exact(discount, 4))


def money(value: Column, digits: int = 2) -> Column:
    """An exact sum, rounded, as a double."""
    return F.round(value, digits).cast("double")


def mean(column: str, digits: int) -> Column:
    """The mean of numbers with two decimals, rounded half away from zero in whole numbers: no tie depends on the order of a sum."""
    total, n = F.sum(F.round(F.col(column) * 100).cast("bigint")), F.count(column)
    steps = F.call_function("div", F.abs(total).cast("decimal(28,0)") * (2 * 10 ** (digits - 2)) + n, 2 * n)
    return F.signum(total) * steps / F.lit(float(10**digits))


def place_among(bounds: Column, value: Column, most: int) -> Column:
    """How many of the sorted bounds, an array of at most `most`, are below value: a binary search of the array."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(bounds, at + step - 1) < value, F.lit(False)), step).otherwise(0))


def day(value: str | Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def moment(value: str | Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
