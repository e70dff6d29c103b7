"""Window columns over one entity's periods (WIN*).

A panel holds one row per entity and period, so a window partition is never longer than the
calendar; raw facts have to be aggregated or de-duplicated to that grain first. All columns built
on the same spec share one exchange, one sort and one Window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def timeline(entity, period) -> WindowSpec:
    """Partition by entity, order by period."""
    entity = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*entity).orderBy(period)


def trailing(spec: WindowSpec, n: int, include_current: bool = False) -> WindowSpec:
    """The n rows before the current one; with include_current the n rows ending at it."""
    return spec.rowsBetween(1 - n, 0) if include_current else spec.rowsBetween(-n, -1)


def lag_mean(c, n: int, spec: WindowSpec, include_current: bool = False) -> Column:
    return F.avg(c).over(trailing(spec, n, include_current))


def lag_sum(c, n: int, spec: WindowSpec, include_current: bool = False) -> Column:
    return F.sum(c).over(trailing(spec, n, include_current))


def lag_std(c, n: int, spec: WindowSpec, include_current: bool = False) -> Column:
    """Sample deviation; frames with fewer than two values give 0."""
    spread = F.stddev_samp(c).over(trailing(spec, n, include_current))
    return F.coalesce(spread, F.lit(0.0))


def trend(short: Column, long: Column) -> Column:
    return short - long


def prev(c, spec: WindowSpec) -> Column:
    return F.lag(c, 1).over(spec)


def rank_in_group(group, order) -> Column:
    """1..n within the group (WIN9). Filter on it with <= n so Spark limits before the shuffle."""
    group = [group] if isinstance(group, str) else list(group)
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


def is_group_start(c, within, order) -> Column:
    """TRUE on the first row and wherever c differs from the row before (WIN10)."""
    spec = Window.partitionBy(*within).orderBy(*order)
    first = F.row_number().over(spec) == 1
    return first | ~F.col(c).eqNullSafe(F.lag(c).over(spec))
