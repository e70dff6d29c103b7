"""The forecast job: landed feeds in, predictions, reports and models out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright import fixed_values as fixed
from panelwright.operators import (
    aggregates,
    clean,
    context,
    features,
    joins,
    models,
    panel,
    scoring,
    split,
)
from panelwright.session import materialise
from panelwright.sources import feeds, schemas, sinks
from panelwright.streaming.refresh import newest_finished, write_mark


@dataclass
class Feeds:
    """The three inputs of a forecast."""

    players: DataFrame
    fixtures: DataFrame
    history: DataFrame


@dataclass
class Forecast:
    """Frames of a finished forecast, all lazily readable."""

    period: int
    predictions: DataFrame
    panel: DataFrame
    periods: DataFrame
    history: DataFrame
    summary: DataFrame
    validation: DataFrame
    models: models.GroupModels
    tables: dict[str, DataFrame] = field(default_factory=dict)


def read_feeds(spark: SparkSession, base: str, history_format: str = "json") -> Feeds:
    """Landing zone: bootstrap.json, fixtures.json and history/<id>.json or history/*.parquet.

    The two documents are parsed once, by many tasks, and written: many later steps read them.
    """
    optional = [*fixed.PER90, "transfers_in_event", "transfers_out_event"]
    players = feeds.read_json_array(spark, f"{base}/bootstrap.json", "elements", schemas.PLAYERS)
    players = materialise(players, "players")
    fixtures = feeds.read_json_records(spark, f"{base}/fixtures.json", schemas.FIXTURES)
    if history_format == "parquet":
        history = feeds.read_history(spark, f"{base}/history")
    else:
        history = feeds.read_entity_history(spark, f"{base}/history", schemas.HISTORY)
    return Feeds(
        clean.drop_empty(players, optional),
        materialise(fixtures, "fixtures"),
        history,
    )


def clean_history(history: DataFrame, double: str = "first") -> DataFrame:
    """Typed history with one row per player and period.

    A player with two matches in a period keeps the first by match id; double="sum" adds them up.
    """
    out = clean.first_present(history, ["round", "event"], "event")
    out = clean.numeric_columns(out, fixed.HISTORY_STATS, default=0.0)
    out = out.withColumns({"player_id": F.col("player_id").cast("bigint"), "event": F.col("event").cast("int")})
    out = clean.require(out, ["player_id", "event"])
    if double == "sum":
        totals = [F.sum(s).alias(s) for s in fixed.HISTORY_STATS]
        return out.groupBy("player_id", "event").agg(*totals)
    order = [F.col("fixture").asc_nulls_last()] if "fixture" in out.columns else []
    kept = panel.first_per_key(out, ["player_id", "event"], [*order, *fixed.HISTORY_STATS])
    return kept.select("player_id", "event", *fixed.HISTORY_STATS)


def enrich_history(history: DataFrame, players: DataFrame, fixtures: DataFrame) -> DataFrame:
    """History with the player's team and that team's match context."""
    played = clean.only_true(fixtures, "finished").withColumnsRenamed(
        {"id": "fixture_id", "kickoff_time": "kickoff"}
    )
    keep = [c for c in ("fixture_id", "kickoff") if c in played.columns]
    match = context.match_context(panel.unpivot_sides(played, keep=keep))
    out = joins.attach(history, players, {"player_id": "id"}, ["team"])
    fills = {"fdr": float(fixed.NEUTRAL_DIFFICULTY), "is_home": 0.0, "score_for": 0.0, "score_ag": 0.0}
    return joins.attach(out, match, ["team", "event"], fills=fills)


def build_panel(history: DataFrame, players: DataFrame, periods: DataFrame) -> DataFrame:
    """Every player in every finished period."""
    return panel.complete_panel(
        players.select(F.col("id").alias("player_id")),
        periods,
        history,
        stats=fixed.HISTORY_STATS + fixed.CONTEXT_STATS,
        fills={"fdr": float(fixed.NEUTRAL_DIFFICULTY)},
    )


def train(
    featured: DataFrame, periods: DataFrame, settings: models.Boosting
) -> tuple[models.GroupModels, DataFrame, DataFrame, DataFrame]:
    """Hold-out validation, then the refit on all rows: models, scored hold-out, errors, counts."""
    first = periods.agg(F.min("event")).scalar()
    common = [c for c in features.common_features() if c in featured.columns]
    learn = split.training_set(featured, first, [*common, "total_points"])
    learn = learn.filter(F.col("element_type").isin(list(fixed.POSITIONS)))
    learn = split.clip_target(split.temporal_split(learn, periods), "total_points", "element_type")
    learn = materialise(learn, "training", ["element_type"])
    names = {g: features.feature_columns(g, learn.columns) for g in fixed.POSITIONS}
    folds = {"trial": F.col("split") == "train", "final": F.lit(True)}
    fitted = models.fit_folds(learn, "element_type", names, "total_points", settings, folds)
    held_out = learn.filter("split = 'val'")
    scored, maes = models.validate(fitted["trial"], held_out, "element_type", "total_points")
    final = fitted["final"]
    return final, scored, maes, aggregates.split_counts(learn)


def forecast(
    inputs: Feeds,
    predict_period: int | None = None,
    settings: models.Boosting = models.Boosting(),
    double_match: str = "mean",
    double_history: str = "first",
) -> Forecast:
    """Features, models, scores and output tables for the next (or the given) period.

    The panel, its features, the training set and the prediction frame are written to the shared
    folder once, because several later steps read each; the last two by group, as models do.
    """
    players, fixtures = inputs.players, inputs.fixtures
    fixtures = fixtures.filter(F.col("event").isNotNull())
    periods = feeds.finished_periods(fixtures)
    last = newest_finished(fixtures)
    period = predict_period or last + 1

    history = enrich_history(clean_history(inputs.history, double_history), players, fixtures)
    rows = materialise(build_panel(history, players, periods), "panel")
    featured = materialise(features.panel_features(rows, players), "features")
    fitted, scored, maes, counts = train(featured, periods, settings)

    ids = players.select(F.col("id").alias("player_id"))
    latest = context.latest_state(featured, ids, last, features.snapshot_columns(), dense=True)
    latest = scoring.with_availability(latest, players)
    match_id = "id" if "id" in fixtures.columns else None
    upcoming = context.upcoming_context(fixtures, period, match_id)
    team = players.select(F.col("id").alias("player_id"), "team")
    strength = context.team_strength(rows, team)
    opponents = context.opponent_strength(strength, fixtures, period, double_match)
    frame = scoring.prediction_frame(players, latest, upcoming, opponents)
    frame = materialise(frame, "frame", ["element_type"])
    predictions = scoring.adjust_predictions(models.score_groups(fitted, frame, "element_type"))
    predictions = materialise(predictions, "predictions")

    validation = scoring.validation_table(scored, players)
    summary = sinks.training_summary(counts, maes, split.period_bounds(periods), "element_type")
    return Forecast(
        period=period,
        predictions=predictions,
        panel=rows,
        periods=periods,
        history=history,
        summary=summary,
        validation=validation,
        models=fitted,
        tables={
            "predictions": scoring.all_ranked(predictions),
            "best_by_position": scoring.best_by_group(predictions),
            "price_signals": scoring.price_signals(predictions),
            "validation": validation,
            "training_summary": summary,
            "player_history": joins.join_suffixed(
                history, clean.select_present(players, fixed.ENTITY_ATTRIBUTES), "player_id", "id"
            ),
        },
    )


def export(result: Forecast, inputs: Feeds, base_uri: str) -> dict[str, str]:
    """Write every output below base_uri, tagged with the period; the marker goes last."""
    spark = result.predictions.sparkSession
    formats = {"training_summary": "json", "player_history": "parquet"}
    written = sinks.export_all(result.tables, base_uri, result.period, formats)
    result.models.save(f"{base_uri}/models/gw={result.period}")
    written["players"] = sinks.write_json(inputs.players, f"{base_uri}/cache/players")
    written["fixtures"] = sinks.write_json(inputs.fixtures, f"{base_uri}/cache/fixtures")
    write_mark(spark, f"{base_uri}/cache/meta", newest_finished(inputs.fixtures))
    return written


def trace(result: Forecast, query: str) -> tuple[DataFrame, DataFrame]:
    """One player's score row and last five periods."""
    return scoring.entity_trace(result.predictions, result.panel, result.periods, query)
