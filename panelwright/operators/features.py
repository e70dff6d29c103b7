"""Leakage-free features of a panel (WIN1-WIN8, SC5, SC7, SC11) and the feature lists (MLP2)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import scalars, windows
from panelwright.operators.aggregates import max_abs
from panelwright.operators.joins import attach


def ewm_features(
    df: DataFrame,
    entity: str,
    period: str,
    stats: Sequence[str],
    span: int = fixed.EWM_SPAN,
    dense: bool = False,
    include_current: bool = False,
    suffix: str = "_ewm",
    block_rows: int | None = None,
    position: str | None = None,
) -> DataFrame:
    """Exponentially weighted mean of all earlier rows, weights adjusted (WIN4).

    A row's weight is growth^position. Positions restart in every block of rows, so weights never
    overflow on long series; the block before is carried with its weights scaled down, and older
    blocks weigh less than a double can show. Both window specs sort alike, so rows are sorted
    once more and not shuffled again.

    NULL values carry no weight; dense=True says there are none, which halves the sums. position
    names a column that already numbers the entity's rows from 0.
    """
    growth = (span + 1) / (span - 1)
    rows = block_rows or max(int(120 * math.log(10) / math.log(growth)), 1)
    if position is None:
        position = "__pos"
        df = df.withColumn(position, F.row_number().over(windows.timeline(entity, period)) - 1)
    df = df.withColumns(
        {
            "__block": F.floor(F.col(position) / rows).cast("int"),
            "__w": F.pow(F.lit(growth), (F.col(position) % rows).cast("double")),
        }
    )
    inside = Window.partitionBy(entity, "__block").orderBy(period)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    before = Window.partitionBy(entity).orderBy("__block").rangeBetween(-1, -1)
    shrink = growth ** (-rows)

    def weighted(value: Column, spec) -> Column:
        return F.sum(value).over(spec)

    def weight_of(stat: str) -> Column:
        return F.col("__w") if dense else F.when(F.col(stat).isNotNull(), F.col("__w"))

    parts: dict[str, tuple[str, Column]] = {}
    for stat in stats:
        parts[f"__n_{stat}"] = (stat, F.col(stat) * F.col("__w"))
        parts["__d" if dense else f"__d_{stat}"] = (stat, weight_of(stat))
    current = {f"{name}_in": weighted(c, inside) for name, (_, c) in parts.items()}
    earlier = {f"{name}_up": weighted(c, before) for name, (_, c) in parts.items()}

    def total(name: str) -> Column:
        zero = F.lit(0.0)
        return F.coalesce(f"{name}_in", zero) + F.coalesce(f"{name}_up", zero) * F.lit(shrink)

    out = df.withColumns(current).withColumns(earlier)
    means = {
        f"{stat}{suffix}": F.try_divide(
            total(f"__n_{stat}"), F.nullif(total("__d" if dense else f"__d_{stat}"), F.lit(0.0))
        )
        for stat in stats
    }
    helpers = [c for c in out.columns if c.startswith("__")]
    return out.withColumns(means).drop(*helpers)


def rolling_features(
    df: DataFrame,
    entity: str,
    period: str,
    stats: Sequence[str],
    short: int = fixed.SHORT_WINDOW,
    long: int = fixed.LONG_WINDOW,
    span: int = fixed.EWM_SPAN,
    dense: bool = False,
    include_current: bool = False,
) -> DataFrame:
    """mean, sum, deviation, ewm, long mean and trend of every statistic (WIN1-WIN6, RSH5).

    By default features of a row see earlier rows only. dense=True says the statistics have no
    NULLs, as in a completed panel: both means are then a sum over the frame's length, and three
    sliding aggregates per statistic do instead of five.
    """
    stats = [s for s in stats if s in df.columns]
    if not stats:
        return df
    spec = windows.timeline(entity, period)
    block: dict[str, Column] = {}
    for s in stats:
        block[f"{s}_sum{short}"] = windows.lag_sum(s, short, spec, include_current)
        block[f"{s}_std{short}"] = windows.lag_std(s, short, spec, include_current)
        if dense:
            block[f"__long_{s}"] = windows.lag_sum(s, long, spec, include_current)
        else:
            block[f"{s}_mean{short}"] = windows.lag_mean(s, short, spec, include_current)
            block[f"{s}_mean{long}"] = windows.lag_mean(s, long, spec, include_current)
    block["__pos"] = F.row_number().over(spec) - 1
    out = df.select("*", *[c.alias(name) for name, c in block.items()])
    if dense:
        seen = F.col("__pos") + (1 if include_current else 0)
        means: dict[str, Column] = {}
        for s in stats:
            for total, n in ((f"{s}_sum{short}", short), (f"__long_{s}", long)):
                rows = F.nullif(F.least(seen, F.lit(n)), F.lit(0))
                means[f"{s}_mean{n}"] = F.col(total) / rows
        out = out.withColumns(means).drop(*[f"__long_{s}" for s in stats])
    trends = {
        f"{s}_trend": windows.trend(F.col(f"{s}_mean{short}"), F.col(f"{s}_mean{long}")) for s in stats
    }
    out = out.withColumns(trends)
    return ewm_features(
        out, entity, period, stats, span, dense, include_current, position="__pos"
    )


def previous_values(df: DataFrame, entity: str, period: str, columns: Sequence[str]) -> DataFrame:
    """The previous period's value of each listed column that exists (WIN7)."""
    spec = windows.timeline(entity, period)
    present = [c for c in columns if c in df.columns]
    return df.select("*", *[windows.prev(c, spec).alias(f"{c}_last") for c in present])


def interaction_columns(
    df: DataFrame, form: str = "total_points_mean5", fdr: str = "fdr", home: str = "is_home"
) -> DataFrame:
    """Form times ease of the match, form at home (SC5)."""
    return df.withColumns(
        {
            "pts_x_fdr": F.col(form) * (F.lit(6) - F.col(fdr)),
            "home_x_form": F.col(home) * F.col(form),
        }
    )


def group_form_columns(df: DataFrame, group: str = "element_type") -> DataFrame:
    """Form columns that count for some groups only (SC7)."""
    g = F.col(group)
    return df.withColumns(
        {
            "cs_form": scalars.masked("clean_sheets_mean5", g.isin(1, 2)),
            "gi_form": scalars.masked("expected_goal_involvements_mean5", g.isin(3, 4)),
            "saves_form": scalars.masked("saves_mean5", g == 1),
        }
    )


def normalise_maxabs(df: DataFrame, column: str, to: str) -> DataFrame:
    """Scale to [-1, 1] by the global largest absolute value (SC11)."""
    return df.withColumn(to, scalars.scale_by_max(column, max_abs(df, column)))


def with_momentum(
    players: DataFrame,
    gained: str = "transfers_in_event",
    lost: str = "transfers_out_event",
    to: str = "transfer_momentum_norm",
) -> DataFrame:
    """Entities with normalised gained - lost; 0 throughout when the feed lacks the counts."""
    if gained not in players.columns or lost not in players.columns:
        return players.withColumn(to, F.lit(0.0))

    def count(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))

    netted = players.withColumn("__net", count(gained) - count(lost))
    return normalise_maxabs(netted, "__net", to).drop("__net")


def momentum(players: DataFrame, key: str = "id", to: str = "transfer_momentum_norm") -> DataFrame:
    """Normalised momentum per entity, to be attached by key (JOI7)."""
    return with_momentum(players, to=to).select(key, to)


def rolled_panel(panel: DataFrame) -> DataFrame:
    """A completed panel with the features that windows over an entity's own periods give."""
    # lags first: they share the sort of the sliding windows, the weighted means sort anew
    out = previous_values(panel, "player_id", "event", fixed.PREVIOUS_STATS)
    return rolling_features(out, "player_id", "event", fixed.ROLLED_STATS, dense=True)


def panel_features(panel: DataFrame, players: DataFrame) -> DataFrame:
    """All features of a completed panel: windows, attributes, interactions, momentum.

    Attributes and momentum come from one join on the entity, which the windows have already
    partitioned and sorted the panel by.
    """
    return with_attributes(rolled_panel(panel), players)


def with_attributes(rolled: DataFrame, players: DataFrame) -> DataFrame:
    """Rows of a rolled panel with attributes, interactions and momentum."""
    out, dim = rolled, with_momentum(players)
    wanted = ["element_type", "now_cost", "selected_by_percent", *fixed.PER90]
    present = [c for c in wanted if c in dim.columns]
    out = attach(
        out.withColumn("pts_trend", F.col("total_points_trend")),
        dim,
        {"player_id": "id"},
        [*present, "transfer_momentum_norm"],
        fills={"transfer_momentum_norm": 0.0},
    )
    return group_form_columns(interaction_columns(out))


def rolled_columns(stats: Sequence[str] = fixed.ROLLED_STATS) -> list[str]:
    """Names of the rolled and previous-value features."""
    kinds = ["mean5", "sum5", "std5", "ewm", "mean19", "trend"]
    names = [f"{s}_{kind}" for kind in kinds for s in stats]
    return names + [f"{c}_last" for c in fixed.PREVIOUS_STATS]


def common_features() -> list[str]:
    """Features every group uses (MLP2)."""
    meta = ["fdr", "is_home", "now_cost", "pts_x_fdr", "home_x_form", "pts_trend"]
    return rolled_columns() + meta + ["transfer_momentum_norm", *fixed.PER90]


def feature_columns(group: int, present: Sequence[str] | None = None) -> list[str]:
    """Features of one group, without repeats and restricted to present columns (MLP2)."""
    names = dict.fromkeys(common_features() + fixed.GROUP_FEATURES.get(group, []))
    return [n for n in names if present is None or n in present]


def snapshot_columns() -> list[str]:
    """Feature columns carried from the last finished period into the forecast."""
    extra = ["pts_trend", "cs_form", "gi_form", "saves_form", "transfer_momentum_norm"]
    return rolled_columns() + extra
