"""Aggregations (AGG*). All are partially aggregated before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.operators.joins import attach
from panelwright.operators.order_stats import percentiles


def mean_by(df: DataFrame, keys: Sequence[str], column: str, to: str | None = None, weight: str | None = None) -> DataFrame:
    """Mean per key combination (AGG1). weight: as how many rows each counts."""
    if weight is not None:
        rows = F.sum(F.when(F.col(column).isNotNull(), F.col(weight)))
        return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(column) * F.col(weight)), rows).alias(to or column))
    return df.groupBy(*keys).agg(F.avg(column).alias(to or column))


def entity_count(df: DataFrame, entity: str, approximate: bool = False) -> DataFrame:
    """Number of distinct entities (AGG3)."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count(entity).alias("n_entities"))


def distinct_periods(df: DataFrame, period: str = "event") -> DataFrame:
    """Distinct non-NULL periods in order (AGG4)."""
    return df.select(period).filter(F.col(period).isNotNull()).distinct().orderBy(period)


def max_abs(df: DataFrame, column: str) -> Column:
    """Largest absolute value as a scalar subquery (AGG5)."""
    return df.agg(F.max(F.abs(column))).scalar()


def mae_by_group(df: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error and row count per group (AGG6)."""
    error = F.abs(F.col(predicted) - F.col(actual))
    return df.groupBy(group).agg(F.avg(error).alias("mae"), F.count(error).alias("n_rows"))


def macro_mae(maes: DataFrame) -> DataFrame:
    """Unweighted mean of the groups' errors (AGG6)."""
    return maes.agg(F.avg("mae").alias("macro_mae"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and shares per split; shares are 0 when there are no rows (AGG7)."""
    counts = df.agg(
        F.count_if(F.col(split) == "train").alias("n_train"),
        F.count_if(F.col(split) == "val").alias("n_val"),
    )
    total = F.col("n_train") + F.col("n_val")

    def share(name: str) -> Column:
        return F.coalesce(F.try_divide(F.lit(100.0) * F.col(name), total), F.lit(0.0))

    return counts.select(
        "n_train", "n_val", share("n_train").alias("train_pct"), share("n_val").alias("val_pct")
    )


def count_in_group(df: DataFrame, column: str, group: str, to: str) -> DataFrame:
    """Non-NULL count of the group on every row (AGG8, WIN11).

    Counted by aggregation and joined back: a window would gather a hot group in one task.
    """
    counts = df.groupBy(group).agg(F.count(column).alias(to))
    return attach(df, counts, group)


def last_non_null(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Each column's last non-NULL value per key, columns taken separately (AGG9)."""
    return df.groupBy(key).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
            for c in columns
        ]
    )


def validation_summary(
    df: DataFrame, entity: str, group: str, period: str, actual: str, predicted: str
) -> DataFrame:
    """Per-entity means, error and period count (AGG2)."""
    error = F.abs(F.col(predicted) - F.col(actual))
    return df.groupBy(entity).agg(
        F.avg(actual).alias("actual_avg"),
        F.avg(predicted).alias("predicted_avg"),
        F.avg(error).alias("mae"),
        F.count(period).alias("gws_eval"),
        F.min(group).alias(group),
    )


def group_percentiles(
    df: DataFrame, column: str, by: Sequence[str], shares: Sequence[float]
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, for groups of any size: `by`, share, value.

    Brackets are narrowed over the rows until few values are left (see order_stats); runs jobs at once.
    """
    return percentiles(df, [column], by, shares).drop("column")


def column_stats(
    df: DataFrame, column: str, by: Sequence[str], percentile: float = 0.88, bounded: bool = False
) -> DataFrame:
    """count, min, max, population deviation, median and one percentile per group (AGG10).

    bounded=True says that groups are short (a top-n report) and uses the built-in percentile.
    """
    x = F.col(f"`{column}`")
    basics = [
        F.count(x).alias("n"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_pop(x).alias("std"),
    ]
    if bounded:
        return df.groupBy(*by).agg(
            *basics, F.median(x).alias("median"), F.percentile(x, F.lit(percentile)).alias("p")
        )
    ranks = group_percentiles(df, column, by, [0.5, percentile])
    wide = ranks.groupBy(*by).agg(
        F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("share") == percentile, F.col("value"))).alias("p"),
    )
    return attach(df.groupBy(*by).agg(*basics), wide, by)


def join_lines(df: DataFrame, line: str, order: Sequence[str], by: Sequence[str] = (), to: str = "text") -> DataFrame:
    """Lines of one report as one ordered text (AGG11); for reports limited beforehand."""
    parts = F.array_sort(F.collect_list(F.struct(*order, line)))
    joined = F.array_join(F.transform(parts, lambda p: p[line]), "\n")
    return df.groupBy(*by).agg(joined.alias(to))
