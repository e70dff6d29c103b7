"""Running sums and maxima of large groups without a window over a whole group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], bucket: str, value: str, out: str,
    total: Callable[[str], Column], join: Callable[[Column, Column], Column], end: int,
) -> DataFrame:
    keys = {c: f"__{i}" for i, c in enumerate([*by, bucket])}
    sums = df.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(total(value).alias("__sum"))
    before = Window.partitionBy(*[keys[c] for c in by]).orderBy(keys[bucket]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys.values(), total("__sum").over(before).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    joined = df.join(sums, same).drop(*keys.values())
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return joined.withColumn(out, join(F.col("__before"), total(value).over(inside))).drop("__before")


def running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], bucket: str, value: str, out: str
) -> DataFrame:
    """Sum of `value` up to and with each row, within `by`, in the order of `bucket`, then `order`.

    bucket: a column that rises with the order and cuts each group into parts of moderate size. Only
    the rows of one bucket meet in a task; the sums of the buckets before come from a small table with
    one row per group and bucket, made with map-side combination. Groups may be null.
    """

    def add(before: Column, inside: Column) -> Column:
        return F.coalesce(before, F.lit(0)) + inside

    return _running(df, by, order, bucket, value, out, F.sum, add, 0)


def running_max(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], bucket: str, value: str, out: str, before: bool = False
) -> DataFrame:
    """Largest `value` up to and with each row, or of the rows before it; as running_sum."""
    return _running(df, by, order, bucket, value, out, F.max, F.greatest, -1 if before else 0)
