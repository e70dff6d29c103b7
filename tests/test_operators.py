"""Joins, reshaping, percentiles, outliers and context on small hand-made frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggregates, context, joins, order_stats, outliers, panel, ranking, split
from panelwright.sources import feeds, schemas


def test_attach_fans_out_and_salt_agrees(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 30)], "id int, w int")
    plain = sorted(joins.attach(left, right, {"k": "id"}).collect(), key=str)
    salted = sorted(joins.attach(left, right, {"k": "id"}, salt=5, salt_by=["v"]).collect(), key=str)
    assert plain == salted and len(plain) == 6 and plain[0].asDict().keys() == {"k", "v", "w"}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_heavy_keys_are_found_and_split(spark, how):
    """A third of the rows have one key, some have none: same rows as a plain join, and no part much longer."""
    rows = spark.range(24_000).selectExpr("if(id % 3 = 0, 7, if(id % 50 = 1, null, id % 4000)) k", "if(id % 3 = 0, 'x', 'y') v", "id")
    dim = spark.range(4000).selectExpr("id", "id * 2 w").unionByName(spark.createDataFrame([(7, -1), (None, 5)], "id long, w long"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert len(joins.heavy_keys(rows, ["k"], 8)) == 1
        rows = rows.withColumnRenamed("id", "row")
        plain = joins.attach(rows, dim, {"k": "id"}, how=how)
        split_ = joins.attach_split(rows, dim, {"k": "id"}, how=how)
        assert sorted(map(str, plain.collect())) == sorted(map(str, split_.collect()))
        sizes = sorted(r["count"] for r in split_.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_join_suffixed(spark):
    left = spark.createDataFrame([(1, 5)], "player_id int, minutes int")
    right = spark.createDataFrame([(1, 900, "x")], "id int, minutes int, name string")
    got = joins.join_suffixed(left, right, "player_id", "id").first()
    assert got.asDict() == {"player_id": 1, "minutes": 5, "id": 1, "minutes_season": 900, "name": "x"}


def test_grid_both_ways(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "p int")
    periods = spark.createDataFrame([(9,), (10,), (31,), (None,)], "event int")
    a = sorted(map(tuple, panel.grid(ids, periods, "p").collect()))
    b = sorted(map(tuple, panel.replicated_grid(ids, periods, "p").collect()))
    assert a == b == [(p, e) for p in (1, 2) for e in (9, 10, 31)]


@pytest.mark.parametrize("most", [None, 1000])
def test_long_calendars(spark, monkeypatch, most):
    """More than 100,000 periods, on either side of the size that tasks hold."""
    if most:
        monkeypatch.setattr(panel, "CALENDAR_BYTES", most)
    ids = spark.createDataFrame([(k,) for k in range(7)], "p int")
    periods = spark.range(120_000).select((F.col("id") * 3).cast("int").alias("event"))
    facts = spark.createDataFrame([(3, 300, 1.0), (3, 301, 9.0), (6, 359_997, 2.0)], "p int, event int, a double")
    out = panel.complete_panel(ids, periods, facts, "p", "event")
    got = out.agg(F.count("*"), F.countDistinct("event"), F.sum("a"), F.count_if(F.col("a") > 0)).first()
    assert tuple(got) == (840_000, 120_000, 3.0, 2)


def test_first_per_key_is_pre_limited(spark):
    df = spark.range(100).selectExpr("id % 2 k", "id v")
    out = panel.first_per_key(df, ["k"], ["v"])
    assert sorted(r.v for r in out.collect()) == [0, 1]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3, 50, 333, 5000])
@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_percentiles_are_exact(spark, n, kind):
    rng = np.random.default_rng(n)
    values = {
        "normal": rng.normal(0, 10, n),
        "ties": rng.integers(0, 3, n).astype(float),
        "heavy": np.where(rng.random(n) < 0.34, 7.0, rng.lognormal(0, 3, n)),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 2, "x": values}))
    shares = [0.0, 0.25, 0.5, 0.88, 1.0]
    got = {(r.g, r.share): r.value for r in aggregates.group_percentiles(df, "x", ["g"], shares).collect()}
    for g in set(np.arange(n) % 2):
        for s in shares:
            assert got[(g, s)] == pytest.approx(np.percentile(values[np.arange(n) % 2 == g], 100 * s), rel=1e-12, abs=1e-12)
    whole = {r.share: r.value for r in aggregates.group_percentiles(df, "x", [], shares).collect()}
    assert whole[0.88] == pytest.approx(np.percentile(values, 88), rel=1e-12, abs=1e-12)


def test_percentiles_of_a_large_group(spark):
    """Far more values than the sketch holds, so the bracket has to do the work."""
    df = spark.range(400_000).selectExpr("0 g", "cast(pmod(hash(id), 1000003) as double) x")
    got = {r.share: r.value for r in aggregates.group_percentiles(df, "x", ["g"], [0.5, 0.88]).collect()}
    values = df.toPandas()["x"]
    assert got == {0.5: np.percentile(values, 50), 0.88: pytest.approx(np.percentile(values, 88))}


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_are_narrowed_pass_by_pass(spark, monkeypatch, seed):
    """Brackets that take several passes, values that very many rows have, several columns, null groups and NaN."""
    monkeypatch.setattr(order_stats, "LOCAL", 8)
    rng = np.random.default_rng(seed)
    n = 6000
    frame = pd.DataFrame({
        "g": rng.choice(["a", "b", None], n, p=[0.8, 0.15, 0.05]),
        "x": np.where(rng.random(n) < 0.4, 3.25, rng.lognormal(0, 8, n) * rng.choice([-1, 1], n)),
        "y": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, [2, 50, 100_000][seed], n).astype(float)),
    })
    shares = [0.0, 0.013, 0.5, 0.7, 0.9999, 1.0]
    got = {(r.g, r.column, r.share): r.value for r in order_stats.percentiles(spark.createDataFrame(frame), ["x", "y"], ["g"], shares).collect()}
    assert len(got) == 3 * 2 * len(shares)
    for (g, c, s), value in got.items():
        mine = frame[frame["g"].isna() if g is None else frame["g"] == g][c].dropna()
        assert value == pytest.approx(np.quantile(mine, s), rel=1e-12)


def test_ranks_of_groups_in_many_parts(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"g": rng.choice([1.0, 2.0, np.nan], 5000, p=[0.9, 0.05, 0.05]), "x": rng.integers(0, 40, 5000), "i": np.arange(5000)})
    rows = [(None if np.isnan(g) else int(g), int(x), int(i)) for g, x, i in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "g int, x int, i int")
    got = {r.i: r.place for r in order_stats.exact_ranks(df, ["g"], [F.col("x").desc(), "i"], "place").collect()}
    want, seen = {}, {}
    for g, x, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g] = want[i] = seen.get(g, 0) + 1
    assert got == want
    assert order_stats.exact_ranks(df.limit(0), ["g"], ["x"]).count() == 0


def test_column_stats_both_ways(spark):
    df = spark.createDataFrame([("a", float(i * i)) for i in range(40)] + [("b", None), ("b", -2.0)], "g string, x double")
    whole = {r.g: r.asDict() for r in aggregates.column_stats(df, "x", ["g"]).collect()}
    short = {r.g: r.asDict() for r in aggregates.column_stats(df, "x", ["g"], bounded=True).collect()}
    assert whole == short


def test_outliers_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.uniform(4, 13, 60), 1)
    y = np.round(x * 0.6 + rng.normal(0, 1.5, 60), 2)
    df = spark.createDataFrame([(i, "MID", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, Pos string, x double, y double")
    out = outliers.flag_outliers(outliers.regression_residuals(df, "Pos", "x", "y"), "Pos", "y")
    got = out.orderBy("id").toPandas()
    slope, intercept = np.polyfit(x, y, 1)
    resid = y - (slope * x + intercept)
    want = (np.abs(resid) > 0.9 * resid.std()) | (y >= np.percentile(y, 88))
    np.testing.assert_allclose(got["resid"], resid, atol=1e-9)
    assert (got["is_outlier"] == want).all()


def test_outlier_edges(spark):
    """One row, constant x, NULL and negative points."""
    rows = [(1, "GK", 5.0, 3.0), (2, "DEF", 4.0, 2.0), (3, "DEF", 4.0, 6.0), (4, "DEF", 4.0, None), (5, "DEF", 4.0, -1.0)]
    df = spark.createDataFrame(rows, "id int, Pos string, x double, y double")
    cand = outliers.outlier_candidates(df, "Pos", "x", "y", {"GK": 5, "DEF": 5}, ["id"])
    assert sorted(r.id for r in cand.collect()) == [1, 2, 3]
    out = outliers.flag_outliers(outliers.regression_residuals(cand, "Pos", "x", "y"), "Pos", "y")
    flags = {r.id: (r.slope, r.is_outlier) for r in out.collect()}
    assert flags == {1: (None, True), 2: (None, True), 3: (None, True)}
    quads = {r.id: r.quadrant for r in outliers.quadrant(cand, "Pos", "x", "y").collect()}
    assert quads == {1: "OVERPRICED", 2: "OVERPRICED", 3: "PREMIUM"}


def test_latest_state_fallback(spark):
    rows = [(1, 1, 5.0, None), (1, 2, None, 3.0), (2, 1, 7.0, 8.0), (2, 3, 9.0, None)]
    df = spark.createDataFrame(rows, "player_id int, event int, a double, b double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "player_id int")
    got = {r.player_id: (r.a, r.b) for r in context.latest_state(df, ids, 3, ["a", "b", "c"]).collect()}
    assert got == {2: (9.0, None), 1: (5.0, 3.0)}


FIXTURE = "fixture_id int, event int, team_h int, team_a int, team_h_difficulty int, team_a_difficulty int, team_h_score int, team_a_score int"


def test_upcoming_context(spark):
    rows = [(1, 5, 10, 20, 4, 2, None, None), (2, 5, 30, 10, 3, 2, None, None), (3, 5, 40, 50, None, 1, None, None), (4, 6, 10, 20, 1, 1, None, None)]
    got = {r.team: r for r in context.upcoming_context(spark.createDataFrame(rows, FIXTURE), 5, "fixture_id").collect()}
    assert (got[10].fdr, got[10].is_home, got[10].num_fixtures) == (2.0, 0.0, 2)
    assert (got[40].fdr, got[40].num_fixtures) == (None, 0)
    assert set(got) == {10, 20, 30, 40, 50}


def test_match_context_takes_the_first_match(spark):
    rows = [(2, 1, 10, 20, 5, 5, 1, 2), (1, 1, 30, 10, 0, None, None, 0)]
    sides = panel.unpivot_sides(spark.createDataFrame(rows, FIXTURE), keep=["fixture_id"])
    got = {r.team: r for r in context.match_context(sides).collect()}
    assert (got[10].is_home, got[10].fdr, got[10].score_for) == (0.0, 3.0, 0.0)
    assert got[30].fdr == 3.0 and got[20].score_ag == 1.0


@pytest.mark.parametrize("n,train", [(1, 1), (2, 2), (3, 2), (5, 4), (10, 8), (13, 10)])
def test_period_bounds(spark, n, train):
    periods = spark.range(1, n + 1).select(F.col("id").cast("int").alias("event"))
    row = split.period_bounds(periods).first()
    assert (row.n_train_periods, row.n_val_periods, row.train_until, row.last_period) == (train, n - train, train, n)


def test_split_counts_without_rows(spark):
    empty = spark.createDataFrame([], "split string")
    assert aggregates.split_counts(empty).first().asDict() == {"n_train": 0, "n_val": 0, "train_pct": 0.0, "val_pct": 0.0}


def test_finished_periods(spark):
    rows = [(1, "True"), (1, "true"), (2, "True"), (2, "False"), (3, "False"), (None, "True")]
    fixtures = spark.createDataFrame(rows, "event int, finished string")
    assert sorted(r.event for r in feeds.finished_periods(fixtures).collect()) == [1, 2]
    assert sorted(r.event for r in feeds.finished_periods(fixtures, complete=True).collect()) == [1]


def test_top_by_limit_limits_before_the_shuffle(spark):
    df = spark.range(300).selectExpr("if(id % 3 = 0, 'A', if(id % 3 = 1, 'B', 'C')) g", "cast(id as double) v", "id")
    out = ranking.top_by_limit(df, "g", "v", {"A": 2, "B": 5}, ["id"])
    assert {(r.g, r.n) for r in out.groupBy("g").agg(F.count("*").alias("n")).collect()} == {("A", 2), ("B", 5)}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_feeds(spark, landing):
    """The broken payload of 47 is skipped; 46 played once."""
    history = feeds.read_entity_history(spark, f"{landing}/history", schemas.HISTORY)
    counts = {r.player_id: r["count"] for r in history.groupBy("player_id").count().collect()}
    assert 47 not in counts and counts[46] == 1 and len(counts) == 47


def test_calendar_and_teams(spark, landing):
    teams = feeds.read_json_array(spark, f"{landing}/bootstrap.json", "teams", schemas.TEAMS)
    events = feeds.read_json_array(spark, f"{landing}/bootstrap.json", "events", schemas.CALENDAR)
    assert teams.count() == 6 and events.filter("finished").agg(F.max("id")).first()[0] == 12


def _panel_inputs(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,), (4,)], "p int")
    periods = spark.createDataFrame([(9,), (10,), (31,), (10,), (None,)], "event int")
    facts = spark.createDataFrame(
        [(1, 9, 1.5, None), (1, 31, 2.0, 4.0), (2, 10, 3.0, 1.0), (3, 9, 9.0, 9.0), (2, 11, 8.0, 8.0), (4, None, 7.0, 7.0)],
        "p int, event int, a double, fdr double",
    )
    return ids, periods, facts


@pytest.mark.parametrize("most", [None, 0])
def test_complete_panel(spark, monkeypatch, most):
    """Gaps and NULLs are filled; facts outside ids or calendar are dropped."""
    if most is not None:
        monkeypatch.setattr(panel, "CALENDAR_BYTES", most)
    out = panel.complete_panel(*_panel_inputs(spark), "p", "event", fills={"fdr": 3.0})
    got = {(r.p, r.event): (r.a, r.fdr) for r in out.collect()}
    facts = {(1, 9): (1.5, 3.0), (1, 31): (2.0, 4.0), (2, 10): (3.0, 1.0)}
    assert out.count() == 9
    assert got == {(p, e): facts.get((p, e), (0.0, 3.0)) for p in (1, 2, 4) for e in (9, 10, 31)}


def test_panel_is_not_shuffled_again(spark):
    """Only ids and facts are exchanged; the windows on top need no exchange and no sort."""
    from panelwright.operators import features

    out = panel.complete_panel(*_panel_inputs(spark), "p", "event")
    alone = out._jdf.queryExecution().executedPlan().toString()
    rolled = features.previous_values(out, "p", "event", ["a"])._jdf.queryExecution().executedPlan().toString()
    for plan in (alone, rolled):
        assert plan.count("Exchange hashpartitioning(p") == 2
        assert plan.count("- Sort [") == 1
