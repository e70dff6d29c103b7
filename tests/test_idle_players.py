"""Players without facts share one panel in forecasts."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelwright.operators import context
from panelwright.plans import queries_forecast, tables as t


@pytest.mark.parametrize("idle", [True, False])
def test_forecast_makes_no_panel_of_each_idle_player(spark, tmp_path, monkeypatch, idle):
    def at(day):
        return datetime.datetime(2024, 1, day)

    users = [1, 1, 2, None, 99, 7, 5] if idle else [None, 99, *range(40)]
    events = [(i, at(1 + i % 9), user, ["view", "purchase", "error"][i % 3], 1.5 + i, None) for i, user in enumerate(users * 9)]
    segments = ["BUILDING", "MACHINERY", None]
    people = [(k, f"c{k}", k % 5 if k % 11 else None, 10.0 * k, segments[k % 3]) for k in range(40)]
    orders = [(i, i % 40, "F", 1.0, at(1 + i), "x") for i in range(28)]
    orders += [(100 + i, i, "F", 1.0, datetime.datetime(2024, m, 1), "x") for i in range(5) for m in range(1, 13)]
    for name, rows in (("events", events), ("customer", people), ("orders", orders)):
        spark.createDataFrame(rows, t.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    every = t.table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"))
    want = queries_forecast._snapshot(spark, d, every)
    whole = context.team_strength(t.match_panel(spark, d), t.players(spark, d).select("player_id", "team"))

    made = []
    monkeypatch.setattr(t, "match_panel", lambda *a: pytest.fail("a panel of all players"))
    rolled = queries_forecast._rolled
    monkeypatch.setattr(queries_forecast, "_rolled", lambda *a: made.append(rolled(*a)) or made[-1])
    got = queries_forecast._snapshot(spark, d)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.count() == 40
    ((frame, blank),) = made
    assert frame.select("player_id").distinct().count() == (5 if idle else 40) and blank == (0 if idle else None)

    if idle:
        absent = t.idle(spark, d).filter(F.col("player_id") != blank)
        panel = t.active_panel(spark, d, blank)
        less = context.team_strength(panel, t.players(spark, d).select("player_id", "team"), blank=blank, absent=absent)
        assert sorted(map(str, less.collect())) == sorted(map(str, whole.collect()))
