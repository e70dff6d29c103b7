"""Regression outliers, quadrants and relative scales per group (OUT*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright import fixed_values as fixed
from panelwright.functions.scalars import clip, scale_min_max
from panelwright.operators import clean
from panelwright.operators.aggregates import column_stats
from panelwright.operators.joins import attach
from panelwright.operators.order_stats import percentiles
from panelwright.operators.ranking import top_by_limit


def outlier_candidates(
    df: DataFrame,
    group: str,
    x: str,
    y: str,
    limits: Mapping | None,
    tie: Sequence[str],
    numbers: Sequence[str] = (),
) -> DataFrame:
    """Rows with x and a positive y, the best per group (OUT1); limits=None keeps all rows."""
    out = clean.numeric_columns(df, [x, y, *numbers])
    out = clean.positive(clean.require(out, [x, y]), y)
    return out if limits is None else top_by_limit(out, group, y, limits, tie)


def regression_residuals(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares line per group and each row's residual (OUT2).

    Where x does not vary there is no slope and the fit is the mean of y. Slope and intercept come from one partial aggregation and are joined back: one row per group.
    """
    lines = df.groupBy(group).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.avg(y).alias("__level"),
    )
    fitted = F.coalesce(F.col("intercept") + F.col("slope") * F.col(x), F.col("__level"))
    out = attach(df, lines, group).withColumn("resid", F.col(y) - fitted)
    return out.drop("__level")


def flag_outliers(
    df: DataFrame,
    group: str,
    y: str,
    factor: float = fixed.RESIDUAL_FACTOR,
    percentile: float = fixed.TOP_PERCENTILE,
    bounded: bool = False,
) -> DataFrame:
    """Far from the line, or among the top values (OUT3, FLT11).

    bounded=True says that groups were cut to a top-n before, so that a task can sort one.
    """
    spread = df.groupBy(group).agg(F.stddev_pop("resid").alias("resid_std"))
    tops = column_stats(df, y, [group], percentile, bounded).select(group, F.col("p").alias("y_top"))
    out = attach(attach(df, spread, group), tops, group)
    far = F.abs("resid") > factor * F.col("resid_std")
    flag = F.coalesce(far, F.lit(False)) | F.coalesce(F.col(y) >= F.col("y_top"), F.lit(False))
    return out.withColumn("is_outlier", flag)


def quadrant(
    df: DataFrame,
    group: str,
    x: str,
    y: str,
    texts: Mapping[str, str] = fixed.QUADRANTS,
    bounded: bool = False,
) -> DataFrame:
    """Quadrant by the group medians (OUT4): low x is below, high y is above its median."""
    if bounded:
        middles = df.groupBy(group).agg(F.median(F.col(f"`{x}`")).alias("x_mid"), F.median(F.col(f"`{y}`")).alias("y_mid"))
    else:
        both = percentiles(df, [x, y], [group], [0.5])
        middles = both.groupBy(group).agg(
            F.max(F.when(F.col("column") == x, F.col("value"))).alias("x_mid"),
            F.max(F.when(F.col("column") == y, F.col("value"))).alias("y_mid"),
        )
    out = attach(df, middles, group)
    low, high = F.col(x) < F.col("x_mid"), F.col(y) > F.col("y_mid")
    label = (
        F.when(low & high, texts["low_high"])
        .when(low, texts["low_low"])
        .when(high, texts["high_high"])
        .otherwise(texts["high_low"])
    )
    return out.withColumn("quadrant", label)


def relative_scales(df: DataFrame, group: str, form: str, share: str) -> DataFrame:
    """Relative size of the form value and min-max position of the share (OUT5, SC12, SC13)."""
    sized = clip(F.coalesce(F.col(form), F.lit(float(fixed.SIZE_NULL))), fixed.SIZE_LOW, float(fixed.SIZE_HIGH))
    owned = F.coalesce(F.col(share), F.lit(float(fixed.SHARE_NULL)))
    out = df.withColumns({"__size": sized, "__share": owned})
    ranges = out.groupBy(group).agg(
        F.max("__size").alias("__size_max"),
        F.min("__share").alias("__low"),
        F.max("__share").alias("__high"),
    )
    out = attach(out, ranges, group)
    divisor = F.when(F.col("__size_max") > 0, F.col("__size_max")).otherwise(F.lit(1.0))
    return out.withColumns(
        {
            "rel_size": F.col("__size") / divisor,
            "rel_share": scale_min_max("__share", "__low", "__high"),
        }
    ).drop("__size", "__share", "__size_max", "__low", "__high")
