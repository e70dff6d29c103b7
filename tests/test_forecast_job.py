"""The forecast job on landed feeds, checked against the same figures in pandas."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright import fixed_values as fixed
from panelwright.operators.models import Boosting, GroupModels
from panelwright.plans import forecast as job
from panelwright.plans import reports
from panelwright.streaming.refresh import read_mark

SMALL = Boosting(rounds=6, learning_rate=0.3, min_rows=3)


@pytest.fixture(scope="module")
def inputs(spark, landing):
    return job.read_feeds(spark, landing)


@pytest.fixture(scope="module")
def result(inputs):
    return job.forecast(inputs, settings=SMALL)


@pytest.fixture(scope="module")
def expected_panel(domain):
    """Dense panel in pandas: first match of a double period, zero-filled gaps."""
    players, fixtures, history = domain
    rows = []
    for pid, matches in history.items():
        for m in matches if pid != 47 else []:
            rows.append({"player_id": pid, "event": m["round"], **{s: float(m[s]) for s in fixed.HISTORY_STATS}})
    facts = pd.DataFrame(rows).drop_duplicates(["player_id", "event"])
    index = pd.MultiIndex.from_product([range(1, 49), range(1, 13)], names=["player_id", "event"])
    return facts.set_index(["player_id", "event"]).reindex(index).fillna(0.0).reset_index()


def test_panel_is_complete(result, expected_panel):
    got = result.panel.select("player_id", "event", *fixed.HISTORY_STATS).toPandas()
    got = got.sort_values(["player_id", "event"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(
        got.astype(float), expected_panel.astype(float), check_dtype=False
    )


def test_context_defaults(result, domain):
    rows = {(r.player_id, r.event): r for r in result.panel.collect()}
    _, fixtures, _ = domain
    home_null, away_zero = fixtures[1], fixtures[2]
    by_team = {p["team"]: p["id"] for p in domain[0]}
    assert rows[(by_team[home_null["team_h"]], home_null["event"])].fdr == 3.0
    assert rows[(by_team[away_zero["team_a"]], away_zero["event"])].fdr == 3.0
    assert rows[(47, 1)].minutes == 0.0 and rows[(47, 1)].fdr == 3.0


def test_predictions_follow_the_rules(result, domain):
    assert result.period == 13
    rows = {r.id: r for r in result.predictions.collect()}
    assert len(rows) == 48
    players = {p["id"]: p for p in domain[0]}
    for pid, r in rows.items():
        team = players[pid]["team"]
        if team == 6:  # no match
            assert r.num_fixtures == 0 and r.raw_predicted_points == 0 and r.predicted_points == 0
        if pid in (2, 3, 4, 6):
            assert r.availability_score == 0 and r.predicted_points == 0
        cap = fixed.PREDICTION_CAP.get(r.element_type, 0)
        doubled = r.num_fixtures >= 2
        assert 0 <= r.raw_predicted_points <= (fixed.DOUBLE_CAP if doubled else cap)
        assert r.value == pytest.approx(r.predicted_points / (players[pid]["now_cost"] / 10), abs=6e-4)
    assert rows[5].availability_score == 0.75
    assert rows[47].availability_score == 0.10
    assert rows[48].raw_predicted_points == 0  # unknown group has no model
    assert rows[1].num_fixtures == 1 and rows[10].num_fixtures == 2


def test_output_tables(result):
    best = result.tables["best_by_position"].toPandas()
    assert list(best.columns) == ["Rank", *fixed.PREDICTION_HEADERS.values()]
    assert list(best["Pos"].drop_duplicates()) == ["GK", "DEF", "MID", "FWD"]
    for _, group in best.groupby("Pos"):
        assert list(group["Rank"]) == list(range(1, 11))
        assert group["PredPts"].is_monotonic_decreasing
    ranked = result.tables["predictions"].toPandas()
    assert ranked["PredPts"].is_monotonic_decreasing and (ranked["Pos"] == "?").sum() == 1
    signals = result.tables["price_signals"].toPandas()
    assert signals["Momentum"].is_monotonic_decreasing
    assert signals["Momentum"].abs().max() == 1.0
    summary = {(r.metric, r.grp): r.value for r in result.summary.collect()}
    assert summary[("n_train_periods", "all")] == 10 and summary[("n_val_periods", "all")] == 2
    assert summary[("train_pct", "all")] + summary[("val_pct", "all")] == pytest.approx(100)
    validation = result.validation.toPandas()
    assert validation["GWsEval"].max() == 2 and set(validation["Pos"]) <= {"GK", "DEF", "MID", "FWD"}


def test_trace(result):
    hit, last = job.trace(result, "ann")
    assert [r.id for r in hit.collect()] == [7]
    assert [r.GW for r in last.collect()] == [8, 9, 10, 11, 12]


def test_models_beat_the_mean_and_reload(spark, result, inputs, tmp_path):
    uri = str(tmp_path / "out")
    job.export(result, inputs, uri)
    assert read_mark(spark, f"{uri}/cache/meta") == 12
    loaded = GroupModels.load(f"{uri}/models/gw=13", list(result.models.models))
    frame = result.predictions.filter("element_type = 2")
    a = [r.p for r in result.models.predict(frame, "element_type", "p").orderBy("id").collect()]
    b = [r.p for r in loaded.predict(frame, "element_type", "p").orderBy("id").collect()]
    assert a == b and len(a) == 12

    predictions = reports.read_predictions(spark, uri)
    report = reports.outlier_report(predictions).toPandas()
    assert len(report) and set(report["Pos"]) <= {"GK", "DEF", "MID", "FWD"}
    assert report["rel_size"].between(0, 1).all()
    text = reports.messages.context_text(reports.read_best(spark, uri)).first()
    assert text.gw == 13 and text.text.startswith("GW13 Predictions:\n\nGK:\n  ")
    assert text.text.count("\n\n") == 4


def test_prediction_error_is_bounded(result, expected_panel):
    """The refit explains the training rows better than their mean does."""
    learned = result.panel.select("total_points").toPandas()["total_points"]
    maes = [r.value for r in result.summary.filter("metric = 'mae'").collect()]
    spread = (learned - learned.mean()).abs().mean()
    assert maes and max(maes) < 3 * spread


def test_period_without_matches(inputs):
    upcoming = job.context.upcoming_context(inputs.fixtures, 40, "id")
    assert upcoming.columns == ["team", "fdr", "is_home", "num_fixtures"] and upcoming.isEmpty()


def test_double_history_sum(spark, inputs, domain):
    summed = job.clean_history(inputs.history, "sum").filter("player_id = 1 AND event = 4").first()
    want = sum(m["total_points"] for m in domain[2][1] if m["round"] == 4)
    assert summed.total_points == want
    first = job.clean_history(inputs.history).filter("player_id = 1 AND event = 4").first()
    assert first.total_points == [m["total_points"] for m in domain[2][1] if m["round"] == 4][0]


def test_fan_out_is_an_option(inputs, result):
    strength = job.context.team_strength(
        result.panel, inputs.players.select(F.col("id").alias("player_id"), "team")
    )
    mean = job.context.opponent_strength(strength, inputs.fixtures, 13)
    fan = job.context.opponent_strength(strength, inputs.fixtures, 13, "fanout")
    assert mean.filter("team = 4").count() == 1 and fan.filter("team = 4").count() == 2


def test_ingest(spark, landing, tmp_path, domain):
    from panelwright.plans.ingest import ingest
    from panelwright.sources import feeds, schemas

    paths = ingest(spark, landing, str(tmp_path / "tables"))
    codes = feeds.read_csv(spark, paths["player_codes"], schemas.PLAYER_CODES).orderBy("id").collect()
    assert [tuple(r) for r in codes[:2]] == [(1, "Player 01", 1), (2, "Player 02", 2)] and len(codes) == 48
    assert feeds.read_csv(spark, paths["team_codes"], schemas.TEAMS).count() == 6
    fixtures = feeds.read_csv(spark, paths["fixtures"], schemas.FIXTURES)
    assert fixtures.count() == len(domain[1]) and fixtures.filter("event IS NULL").count() == 1
    assert set(spark.read.option("header", True).csv(paths["players"]).columns) == set(domain[0][0])


def test_feed_without_optional_columns(spark):
    """A stated schema shows absent columns as NULL; those must not empty the training set."""
    bare = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, name string, saves_per_90 double")
    assert job.clean.drop_empty(bare, ["name", "saves_per_90", "other"]).columns == ["id", "name"]


def test_calendar_without_finished_matches(inputs):
    """Nothing has finished yet: no periods, an empty panel, mark 0."""
    none = inputs.fixtures.withColumn("finished", F.lit("False"))
    periods = job.feeds.finished_periods(none)
    assert job.newest_finished(none) == 0 and periods.isEmpty()
    assert job.build_panel(job.enrich_history(job.clean_history(inputs.history), inputs.players, none), inputs.players, periods).isEmpty()


def test_queries_fit_all_rounds():
    from panelwright.plans import queries_forecast

    assert queries_forecast.QUERY_SETTINGS == Boosting()
    assert (Boosting().rounds, Boosting().learning_rate) == (800, 0.03)
