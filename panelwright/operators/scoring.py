"""Forecast rows, business rules and output tables (SCR4, SCR6-SCR8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import scalars
from panelwright.operators import clean, joins, ranking
from panelwright.operators.aggregates import validation_summary
from panelwright.operators.features import interaction_columns, snapshot_columns
from panelwright.operators.split import periods_tail


def with_availability(latest: DataFrame, players: DataFrame, entity: str = "player_id") -> DataFrame:
    """Average minutes and availability of every snapshot row (JOI9, SC8)."""
    status = players.select(
        F.col("id"),
        F.col("status").alias("__status"),
        scalars.null_if_nan(F.col("chance_of_playing_next_round").try_cast("double")).alias("__chance"),
    )
    out = latest.withColumn(
        "avg_minutes_last5", F.col("minutes_sum5") / F.lit(float(fixed.SHORT_WINDOW))
    )
    out = joins.attach(out, status, {entity: "id"})
    score = scalars.availability("__status", "__chance", "avg_minutes_last5")
    return out.withColumn("availability_score", score).drop("__status", "__chance")


def prediction_frame(
    players: DataFrame, latest: DataFrame, upcoming: DataFrame, strength: DataFrame
) -> DataFrame:
    """Entities with their snapshot, next match and opponent, defaults in the gaps (SCR4, JOI10)."""
    out = joins.attach(players, latest, {"id": "player_id"})
    out = joins.attach(out, upcoming, "team")
    out = joins.attach(out, strength, "team")
    out = clean.ensure_columns(out, [*snapshot_columns(), *fixed.PER90, "now_cost"], 0.0)
    zeros = {c: 0.0 for c in [*snapshot_columns(), *fixed.PER90]}
    out = clean.fill_defaults(
        out.withColumn("num_fixtures", F.col("num_fixtures").cast("double")),
        {
            **zeros,
            "now_cost": 0,
            "fdr": float(fixed.NEUTRAL_DIFFICULTY),
            "is_home": 0.0,
            "num_fixtures": 0.0,
            "avg_minutes_last5": 0.0,
            "availability_score": fixed.LOWEST_AVAILABILITY,
            "opp_def_weakness": fixed.NEUTRAL_STRENGTH,
        },
    )
    return interaction_columns(out)


def adjusted_raw(
    raw: str, fixtures: str, group: str, multipliers: Mapping = fixed.DOUBLE_MULTIPLIER
) -> Column:
    """Raw points: 0 without a match, multiplied and capped with two or more (SC10)."""
    factor = scalars.lookup(group, {k: float(v) for k, v in multipliers.items()})
    doubled = scalars.clip(F.col(raw) * factor, high=float(fixed.DOUBLE_CAP))
    is_double = (F.col(fixtures) >= 2) & factor.isNotNull()
    out = scalars.update_where(raw, is_double, doubled)
    return scalars.update_where(out, F.col(fixtures) == 0, F.lit(0.0))


def adjust_predictions(
    df: DataFrame, group: str = "element_type", multipliers: Mapping = fixed.DOUBLE_MULTIPLIER
) -> DataFrame:
    """Final points, price, value and price signal (SCR6)."""
    out = df.withColumn(
        "raw_predicted_points", adjusted_raw("raw_predicted_points", "num_fixtures", group, multipliers)
    )
    points = F.col("raw_predicted_points") * F.col("availability_score")
    out = out.withColumns(
        {"predicted_points": scalars.round_half_even(points, 2), "price_m": F.col("now_cost") / 10.0}
    )
    value = scalars.value_ratio("predicted_points", "price_m")
    return out.withColumns(
        {
            "value": scalars.round_half_even(value, 3),
            "price_signal": scalars.price_signal("transfer_momentum_norm", "total_points_mean5"),
        }
    )


# --- output tables ----------------------------------------------------------


def _display(
    df: DataFrame, headers: Mapping[str, str], labels: Mapping, extra: Sequence[str] = ()
) -> DataFrame:
    shown = clean.select_present(df, [*headers, *extra])
    if labels and "element_type" in shown.columns:
        shown = shown.withColumn("element_type", scalars.map_codes("element_type", labels))
    return clean.rename_map(shown, headers)


def all_ranked(
    df: DataFrame,
    labels: Mapping = fixed.POSITIONS,
    headers: Mapping[str, str] = fixed.PREDICTION_HEADERS,
    by: str = "predicted_points",
    key: str = "id",
    keep_key: bool = False,
) -> DataFrame:
    """Every entity, best prediction first, display headers (SCR7)."""
    shown = _display(ranking.ranked(df, by, [key]), headers, labels, [key] if keep_key else [])
    return shown


def best_by_group(
    df: DataFrame,
    labels: Mapping = fixed.POSITIONS,
    headers: Mapping[str, str] = fixed.PREDICTION_HEADERS,
    n: int = fixed.REPORT_TOP,
    by: str = "predicted_points",
    key: str = "id",
    group: str = "element_type",
) -> DataFrame:
    """The n best of every known group, ranked, display headers (SCR7)."""
    known = df.filter(F.col(group).isin(list(labels)))
    top = ranking.top_per_group(known, group, by, n, [key])
    place = scalars.lookup(group, {k: i for i, k in enumerate(labels)})
    ordered = top.orderBy(place, "Rank")
    return _display(ordered.select("Rank", *df.columns), {"Rank": "Rank", **headers}, labels)


def price_signals(
    df: DataFrame,
    labels: Mapping = fixed.POSITIONS,
    headers: Mapping[str, str] = fixed.SIGNAL_HEADERS,
    by: str = "transfer_momentum_norm",
    key: str = "id",
) -> DataFrame:
    """Price signals, strongest momentum first (SCR7)."""
    return _display(ranking.ranked(df, by, [key]), headers, labels)


def validation_table(
    scored: DataFrame,
    players: DataFrame,
    labels: Mapping = fixed.POSITIONS,
    headers: Mapping[str, str] = fixed.VALIDATION_HEADERS,
    entity: str = "player_id",
    group: str = "element_type",
    actual: str = "total_points",
    predicted: str = "predicted",
) -> DataFrame:
    """Per-entity validation with names and rounded figures (SCR7, JOI8)."""
    out = validation_summary(scored, entity, group, "event", actual, predicted)
    out = joins.attach(out, players, {entity: "id"}, ["web_name"])
    out = out.withColumns(
        {
            "actual_avg": scalars.round_half_even("actual_avg", 2),
            "predicted_avg": scalars.round_half_even("predicted_avg", 2),
            "mae": scalars.round_half_even("mae", 3),
        }
    )
    return _display(out, headers, labels)


def find_entity(entities: DataFrame, name: str, query: str, key: str = "id") -> DataFrame:
    """The key of the first entity whose name matches, to restrict facts by before anything is computed (SCR8)."""
    return clean.name_search(entities, name, query).orderBy(key).limit(1).select(key)


def entity_trace(
    predictions: DataFrame,
    panel: DataFrame,
    periods: DataFrame,
    query: str,
    entity: str = "player_id",
    key: str = "id",
    name: str = "web_name",
    headers: Mapping[str, str] = fixed.TRACE_HEADERS,
    n: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """The first entity whose name matches: its score row and its last n periods (SCR8)."""
    hit = clean.name_search(predictions, name, query).orderBy(key).limit(1)
    wanted = hit.select(F.col(key).alias(entity))
    rows = joins.restrict_to(panel, wanted, entity)
    rows = joins.restrict_to(rows, periods_tail(periods, n), "event")
    last = clean.rename_map(clean.select_present(rows.orderBy("event"), list(headers)), headers)
    return hit, last
