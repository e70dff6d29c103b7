"""Registered queries: features, split, context, scoring, rules, models, output tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import scalars, windows
from panelwright.operators import (
    aggregates,
    clean,
    context,
    features,
    joins,
    models,
    panel,
    ranking,
    scoring,
    split,
)
from panelwright.plans import tables as t
from panelwright.plans.queries_panel import FRAME5, FRAME19
from panelwright.plans.registry import query
from panelwright.plans.tables import rint, s6, sql_sides, sql_with
from panelwright.session import materialise
from panelwright.sources import sinks

LABELS = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}
SQL_LABEL = "CASE element_type WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' ELSE '?' END"


def _sql_by_group(column: str, table: dict) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in table.items())
    return f"CASE {column} {cases} END"


# --- split and training set -------------------------------------------------

SQL_SPLIT = """
cal AS (SELECT event, row_number() OVER (ORDER BY event) AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT event FROM matches WHERE finished)),
bounds AS (SELECT min(event) AS first_period, max(event) AS last_period, CAST(max(n) AS INTEGER) AS n_periods,
  CAST(greatest(1, round_even(max(n) * 0.8::DOUBLE, 0)) AS INTEGER) AS n_train FROM cal)"""


@query(
    "finished_split",
    "SRC8 MLP1 SRT5 AGG4 AGG7",
    sql_with(t.SQL_MATCHES, SQL_SPLIT)
    + """, s AS (SELECT m.event <= c.event AS tr FROM matches m, bounds b, cal c
      WHERE c.i = b.n_train AND m.finished)
    SELECT first_period, last_period, n_periods, n_train AS n_train_periods, n_periods - n_train AS n_val_periods,
      (SELECT event FROM cal WHERE i = n_train) AS train_until,
      (SELECT count(*) FILTER (WHERE tr) FROM s) AS n_train, (SELECT count(*) FILTER (WHERE NOT tr) FROM s) AS n_val,
      (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE tr) / count(*), 6) FROM s) AS train_pct,
      (SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE NOT tr) / count(*), 6) FROM s) AS val_pct
    FROM bounds""",
)
def finished_split(spark, sf):
    played = clean.only_true(t.matches(spark, sf), "finished")
    periods = played.select("event").distinct()
    counts = aggregates.split_counts(split.temporal_split(played, periods))
    counts = t.rounded(counts, ["train_pct", "val_pct"])
    bounds = split.period_bounds(periods)
    row = counts.select(F.struct(*counts.columns)).scalar()
    return bounds.withColumn("c", row).select(*bounds.columns, "c.*")


@query(
    "temporal_split",
    "MLP1",
    sql_with(t.SQL_MATCHES, SQL_SPLIT)
    + """SELECT m.fixture_id, m.event, CASE WHEN m.event <= (SELECT event FROM cal, bounds WHERE i = n_train)
      THEN 'train' ELSE 'val' END AS split FROM matches m""",
)
def temporal_split(spark, sf):
    fixtures = t.matches(spark, sf)
    periods = clean.only_true(fixtures, "finished").select("event").distinct()
    return split.temporal_split(fixtures.select("fixture_id", "event"), periods)


def _featured(spark, sf):
    """All features of the driver panel, with the day's split."""
    rows = t.match_panel(spark, sf)
    return features.panel_features(rows, t.entities(spark, sf))


SQL_FEATURED = (
    t.SQL_FACTS.strip(),
    t.SQL_PLAYERS,
    t.SQL_CONTEXT,
    t.SQL_MATCH_PANEL,
    t.SQL_MOMENTUM,
    f"""featured AS (
  SELECT player_id, event, fdr, is_home, total_points, minutes, element_type, now_cost, team, momentum,
    {s6(f'avg(total_points) OVER {FRAME5}')} AS form, {s6(f'avg(minutes) OVER {FRAME5}')} AS minutes_mean5,
    {s6(f'sum(minutes) OVER {FRAME5}')} AS minutes_sum5,
    {s6(f'avg(total_points) OVER {FRAME5} - avg(total_points) OVER {FRAME19}')} AS pts_trend,
    {s6(f'avg(clean_sheets) OVER {FRAME5}')} AS cs5, {s6(f'avg(saves) OVER {FRAME5}')} AS saves5,
    {s6(f'avg(expected_goal_involvements) OVER {FRAME5}')} AS xgi5,
    lag(expected_goal_involvements) OVER (PARTITION BY player_id ORDER BY event) AS xgi_last,
    {s6(f'avg(score_ag) OVER {FRAME5}')} AS conceded5,
    {s6(f'avg(total_points) OVER {FRAME5} * (6 - fdr)')} AS ease_form,
    {s6(f'is_home * avg(total_points) OVER {FRAME5}')} AS home_form
  FROM match_panel LEFT JOIN players USING (player_id) LEFT JOIN momentum USING (player_id))""",
)


@query(
    "panel_features",
    "SC5 SC7 JOI6 JOI7 WIN1 WIN6 WIN7 RSH5",
    sql_with(*SQL_FEATURED)
    + f"""SELECT player_id, event, element_type, now_cost, form AS total_points_mean5, pts_trend,
      ease_form AS pts_x_fdr, home_form AS home_x_form,
      {s6("cs5 * (element_type IN (1, 2))::INTEGER")} AS cs_form,
      {s6("xgi5 * (element_type IN (3, 4))::INTEGER")} AS gi_form,
      {s6("saves5 * (element_type = 1)::INTEGER")} AS saves_form, xgi_last AS expected_goal_involvements_last,
      conceded5 AS score_ag_mean5, {s6("momentum")} AS transfer_momentum_norm
    FROM featured""",
)
def panel_features(spark, sf):
    shown = [
        "total_points_mean5", "pts_trend", "pts_x_fdr", "home_x_form", "cs_form", "gi_form", "saves_form",
        "score_ag_mean5", "transfer_momentum_norm",
    ]
    out = _featured(spark, sf)
    keys = ["player_id", "event", "element_type", "now_cost", "expected_goal_involvements_last"]
    return t.rounded(out.select(*keys, *shown), shown)


@query(
    "training_set",
    "MLP3 MLP4 MLP2 FLT3 FLT4 FLT5 SC3",
    sql_with(*SQL_FEATURED)
    + f"""SELECT player_id, event, element_type, form AS total_points_mean5, pts_trend,
      1.0::DOUBLE AS opp_def_weakness, CASE WHEN element_type = 5 THEN total_points
        ELSE least(total_points, {_sql_by_group("element_type", fixed.TARGET_CAP)}) END AS total_points
    FROM featured WHERE event > (SELECT min(event) FROM periods) AND minutes_mean5 > 1
      AND xgi_last IS NOT NULL""",
)
def training_set(spark, sf):
    rows = features.panel_features(t.active_panel(spark, sf), t.entities(spark, sf))
    first = t.periods(spark, sf).agg(F.min("event")).scalar()
    needed = [c for c in features.common_features() if c in rows.columns] + ["total_points"]
    learn = split.training_set(rows, first, needed)
    learn = split.clip_target(learn, "total_points", "element_type")
    out = learn.select(
        "player_id", "event", "element_type", "total_points_mean5", "pts_trend", "opp_def_weakness",
        "total_points",
    )
    return t.rounded(out, ["total_points_mean5", "pts_trend"])


@query(
    "training_set_with_strength",
    "MLP3 SCR3",
    sql_with(*SQL_FEATURED)
    + f""", team_day AS (SELECT team, event, avg(score_ag) AS c FROM match_panel
        JOIN players USING (player_id) GROUP BY 1, 2),
      strength AS (SELECT team, event, avg(c) OVER (PARTITION BY team ORDER BY event
        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS w FROM team_day)
    SELECT f.player_id, f.event, {s6("coalesce(s.w, 1.0::DOUBLE)")} AS opp_def_weakness
    FROM featured f LEFT JOIN strength s ON s.team = (f.team + 1) % 25 AND s.event = f.event
    WHERE f.event > (SELECT min(event) FROM periods) AND f.minutes_mean5 > 1""",
)
def training_set_with_strength(spark, sf):
    rows = t.match_panel(spark, sf)
    team = t.players(spark, sf).select("player_id", "team")
    strength = context.team_strength(rows, team)
    spec = windows.timeline("player_id", "event")
    slim = rows.select(
        "player_id", "event", windows.lag_mean("minutes", 5, spec).alias("minutes_mean5")
    )
    slim = joins.attach(slim, team, "player_id").withColumn("opponent", (F.col("team") + 1) % 25)
    first = t.periods(spark, sf).agg(F.min("event")).scalar()
    learn = split.training_set(slim, first, ["minutes_mean5"], strength=strength)
    return t.rounded(learn.select("player_id", "event", "opp_def_weakness"), ["opp_def_weakness"])


# --- context ----------------------------------------------------------------


@query(
    "latest_state",
    "SCR1 AGG9 JOI12 JOI13 SET1 SET2 FLT2",
    sql_with(t.SQL_FACTS)
    + """, sparse AS (SELECT player_id, event, nullif(goals_scored, 0) AS goals_scored, minutes FROM facts),
      here AS (SELECT player_id, goals_scored, minutes FROM sparse WHERE event = (SELECT max(event) FROM periods))
    SELECT * FROM here UNION ALL
    SELECT player_id, arg_max(goals_scored, event) FILTER (WHERE goals_scored IS NOT NULL), arg_max(minutes, event)
    FROM sparse WHERE player_id NOT IN (SELECT player_id FROM here) GROUP BY 1""",
)
def latest_state(spark, sf):
    facts = t.facts(spark, sf)
    sparse = facts.withColumn("goals_scored", F.nullif(F.col("goals_scored"), F.lit(0.0)))
    ids = t.players(spark, sf)
    return context.latest_state(sparse, ids, t.last_day(spark, sf), ["goals_scored", "minutes", "nope"])


SQL_UPCOMING = sql_with(t.SQL_CALENDAR_MATCHES, sql_sides("calendar", defaults=False)) + """,
upcoming AS (SELECT * FROM sides WHERE event = (SELECT hi + 1 FROM span)),
ctx AS (SELECT team, fdr, is_home, count(fdr) OVER (PARTITION BY team) AS num_fixtures FROM upcoming
  QUALIFY row_number() OVER (PARTITION BY team ORDER BY fdr, is_home DESC, fixture_id) = 1)"""


@query("upcoming_context", "SCR2 AGG8 WIN11 RSH4", SQL_UPCOMING + "SELECT * FROM ctx")
def upcoming_context(spark, sf):
    fixtures = t.calendar_matches(spark, sf)
    return context.upcoming_context(fixtures, t.last_day(spark, sf) + 1, "fixture_id")


SQL_STRENGTH = """
team_day AS (SELECT team, event, avg(score_ag) AS c FROM match_panel JOIN players USING (player_id) GROUP BY 1, 2),
strength AS (SELECT team, event, avg(c) OVER (PARTITION BY team ORDER BY event
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS w FROM team_day),
latest AS (SELECT team AS opponent, w FROM strength WHERE event = (SELECT max(event) FROM periods)),
next_sides AS (SELECT team_h AS team, team_a AS opponent, fixture_id FROM calendar, span WHERE event = hi + 1
  UNION ALL SELECT team_a, team_h, fixture_id FROM calendar, span WHERE event = hi + 1)"""


@query(
    "team_strength",
    "AGG1 WIN8 JOI5 SCR3",
    sql_with(t.SQL_FACTS, t.SQL_PLAYERS, t.SQL_CONTEXT, t.SQL_MATCH_PANEL, SQL_STRENGTH)
    + f"SELECT team, event, {s6('w')} AS opp_def_weakness FROM strength",
)
def team_strength(spark, sf):
    team = t.players(spark, sf).select("player_id", "team")
    out = context.team_strength(t.match_panel(spark, sf), team)
    return t.rounded(out, ["opp_def_weakness"]).drop("score_ag")


def _opponents(spark, sf, double):
    rows = t.match_panel(spark, sf)
    strength = context.team_strength(rows, t.players(spark, sf).select("player_id", "team"))
    fixtures = t.calendar_matches(spark, sf)
    return context.opponent_strength(strength, fixtures, t.last_day(spark, sf) + 1, double)


@query(
    "opponent_strength",
    "SCR3 JOI11 AGG1 WIN8",
    sql_with(t.SQL_FACTS, t.SQL_PLAYERS, t.SQL_CONTEXT, t.SQL_MATCH_PANEL, SQL_STRENGTH)
    + f"""SELECT team, {s6("avg(coalesce(w, 1.0::DOUBLE))")} AS opp_def_weakness
    FROM next_sides LEFT JOIN latest USING (opponent) GROUP BY 1""",
)
def opponent_strength(spark, sf):
    return t.rounded(_opponents(spark, sf, "mean"), ["opp_def_weakness"])


@query(
    "opponent_strength_fanout",
    "SCR3 JOI11",
    sql_with(t.SQL_FACTS, t.SQL_PLAYERS, t.SQL_CONTEXT, t.SQL_MATCH_PANEL, SQL_STRENGTH)
    + f"""SELECT team, {s6("coalesce(w, 1.0::DOUBLE)")} AS opp_def_weakness
    FROM next_sides LEFT JOIN latest USING (opponent)""",
)
def opponent_strength_fanout(spark, sf):
    return t.rounded(_opponents(spark, sf, "fanout"), ["opp_def_weakness"])


# --- rules and forecast tables ----------------------------------------------

# The group mean of recent form stands in for the model in the queries that need exact twins.
SQL_FORECAST = (
    *SQL_FEATURED,
    """next_ctx AS (
  SELECT team, fdr, is_home, CAST(count(*) OVER (PARTITION BY team) AS DOUBLE) AS num_fixtures FROM (
    SELECT team_h AS team, team_h_difficulty::DOUBLE AS fdr, 1.0::DOUBLE AS is_home, fixture_id
      FROM calendar, span WHERE event = hi + 1
    UNION ALL SELECT team_a, team_a_difficulty::DOUBLE, 0.0::DOUBLE, fixture_id
      FROM calendar, span WHERE event = hi + 1)
  QUALIFY row_number() OVER (PARTITION BY team ORDER BY fdr, is_home DESC, fixture_id) = 1)""",
    f"""snap AS (
  SELECT p.player_id AS id, web_name, p.element_type, p.team, p.now_cost, status, chance, f.form, f.momentum,
    f.minutes_sum5 / 5.0::DOUBLE AS avg_min, coalesce(c.fdr, 3.0::DOUBLE) AS fdr,
    coalesce(c.is_home, 0.0::DOUBLE) AS is_home, coalesce(c.num_fixtures, 0.0::DOUBLE) AS num_fixtures,
    CASE WHEN status IN ('i', 'u', 's') THEN 0.0::DOUBLE WHEN chance IS NOT NULL THEN chance / 100
      WHEN f.minutes_sum5 / 5 >= 75 THEN 1.0::DOUBLE WHEN f.minutes_sum5 / 5 >= 60 THEN 0.9::DOUBLE
      WHEN f.minutes_sum5 / 5 >= 45 THEN 0.75::DOUBLE WHEN f.minutes_sum5 / 5 >= 30 THEN 0.55::DOUBLE
      WHEN f.minutes_sum5 / 5 >= 15 THEN 0.35::DOUBLE ELSE 0.1::DOUBLE END AS avail
  FROM players p JOIN featured f USING (player_id) LEFT JOIN next_ctx c ON c.team = p.team
  WHERE f.event = (SELECT max(event) FROM periods))""",
    f"""raw AS (
  SELECT *, {rint(f'least(form, coalesce({_sql_by_group("element_type", fixed.PREDICTION_CAP)}, form))', 2)} AS raw0
  FROM snap),
adjusted AS (
  SELECT *, CASE WHEN num_fixtures = 0 THEN 0.0::DOUBLE WHEN num_fixtures >= 2 AND element_type <= 4
    THEN least(raw0 * {_sql_by_group("element_type", fixed.DOUBLE_MULTIPLIER)}, 20.0::DOUBLE)
    ELSE raw0 END AS raw1 FROM raw),
scored AS (
  SELECT *, {rint("raw1 * avail", 2)} AS pred, now_cost / 10.0::DOUBLE AS price_m FROM adjusted),
forecast AS (
  SELECT *, {rint("pred / greatest(price_m, 0.1::DOUBLE)", 3)} AS value,
    CASE WHEN momentum > 0.3 AND form > 4 THEN '{fixed.SIGNAL_RISE}'
      WHEN momentum < -0.3 OR form < 1 THEN '{fixed.SIGNAL_FALL}' ELSE '{fixed.SIGNAL_STABLE}' END AS signal
  FROM scored)""",
)


def _rolled(spark, sf):
    """The rolled panel of the players with facts and of one without, as good as all of these, and that one's id."""
    blank = t.idle(spark, sf).agg(F.min("player_id")).first()[0]
    return features.rolled_panel(t.active_panel(spark, sf, blank)), blank


def _snapshot(spark, sf, ids=None, rolled=None):
    """Prediction frame of the driver tables for the day after the last one.

    ids: the players wanted; then only their facts and those of their opponents' players are read into panels. Else the
    players without facts share the panel of one of them. rolled: what _rolled gave, if written already.
    """
    people = t.entities(spark, sf)
    last = t.last_day(spark, sf)
    blank = absent = None
    if ids is not None:
        rows = t.match_panel(spark, sf, ids)
        featured = features.panel_features(rows, people)
    else:
        found, blank = rolled or _rolled(spark, sf)
        rows = found if rolled else t.active_panel(spark, sf, blank)
        found = clean.at_period(found, last)
        if blank is not None:
            found = found if rolled else materialise(found, "rolled")
            absent = t.idle(spark, sf).filter(F.col("player_id") != blank)
            found = context.with_absent(found, absent, blank)
        featured = features.with_attributes(found, people)
    fixtures = t.calendar_matches(spark, sf)
    team = people.select(F.col("id").alias("player_id"), "team")
    if ids is not None:
        people = joins.restrict_to(people, ids.withColumnRenamed("player_id", "id"), "id")
        next_sides = panel.unpivot_sides(clean.at_period(fixtures, last + 1), defaults=False).select("team", "opponent")
        facing = joins.restrict_to(next_sides, people, "team").select(F.col("opponent").alias("team"))
        rows = t.match_panel(spark, sf, joins.restrict_to(team, facing, "team").select("player_id"))
    wanted = people.select(F.col("id").alias("player_id"))
    latest = context.latest_state(featured, wanted, last, features.snapshot_columns(), dense=True)
    latest = t.rounded(latest, ["total_points_mean5", "minutes_sum5"])
    latest = scoring.with_availability(latest, people)
    upcoming = context.upcoming_context(fixtures, last + 1, "fixture_id")
    strength = context.team_strength(rows, team, blank=blank, absent=absent)
    opponents = context.opponent_strength(strength, fixtures, last + 1)
    return scoring.prediction_frame(people, latest, upcoming, opponents)


def _forecast(spark, sf, ids=None):
    frame = _snapshot(spark, sf, ids)
    cap = scalars.lookup("element_type", {k: float(v) for k, v in fixed.PREDICTION_CAP.items()})
    form = F.col("total_points_mean5")
    raw = F.when(form > cap, cap).otherwise(form)
    frame = frame.withColumn("raw_predicted_points", scalars.round_half_even(raw, 2))
    return scoring.adjust_predictions(frame)


@query(
    "availability_rules",
    "SC8 JOI9",
    sql_with(*SQL_FORECAST)
    + "SELECT id AS player_id, avg_min AS avg_minutes_last5, avail AS availability_score FROM snap",
)
def availability_rules(spark, sf):
    spec = windows.timeline("player_id", "event")
    minutes = t.panel(spark, sf).select(
        "player_id", "event", windows.lag_sum("minutes", 5, spec).alias("minutes_sum5")
    )
    latest = clean.at_period(minutes, t.last_day(spark, sf))
    out = scoring.with_availability(latest, t.entities(spark, sf))
    return out.select("player_id", "avg_minutes_last5", "availability_score")


@query(
    "price_signal",
    "SC9",
    sql_with(*SQL_FORECAST) + "SELECT id, signal AS price_signal FROM forecast",
)
def price_signal(spark, sf):
    spec = windows.timeline("player_id", "event")
    form = t.r6(windows.lag_mean("total_points", 5, spec)).alias("form")
    latest = clean.at_period(t.panel(spark, sf).select("player_id", "event", form), t.last_day(spark, sf))
    moved = joins.attach(latest, features.momentum(t.entities(spark, sf)), {"player_id": "id"})
    signal = scalars.price_signal("transfer_momentum_norm", "form")
    return moved.select(F.col("player_id").alias("id"), signal.alias("price_signal"))


@query(
    "prediction_frame",
    "SCR4 JOI10 RSH6 SC5",
    sql_with(*SQL_FORECAST, SQL_STRENGTH.replace("latest AS", "latest_w AS"),
             """opp AS (SELECT team, avg(coalesce(w, 1.0::DOUBLE)) AS w FROM next_sides
               LEFT JOIN latest_w USING (opponent) GROUP BY 1)""")
    + f"""SELECT id, element_type, snap.team, fdr, is_home, num_fixtures, avail AS availability_score,
      {s6("form * (6 - fdr)")} AS pts_x_fdr, {s6("is_home * form")} AS home_x_form,
      {s6("coalesce(opp.w, 1.0::DOUBLE)")} AS opp_def_weakness FROM snap LEFT JOIN opp USING (team)""",
)
def prediction_frame(spark, sf):
    noisy = ["pts_x_fdr", "home_x_form", "opp_def_weakness"]
    keys = ["id", "element_type", "team", "fdr", "is_home", "num_fixtures", "availability_score"]
    return t.rounded(_snapshot(spark, sf).select(*keys, *noisy), noisy)


@query(
    "adjust_predictions",
    "SCR6 SC3 SC4 SC10 PRJ6",
    sql_with(*SQL_FORECAST)
    + f"""SELECT id, {s6("raw1")} AS raw_predicted_points, pred AS predicted_points, price_m, value,
      signal AS price_signal FROM forecast""",
)
def adjust_predictions(spark, sf):
    out = _forecast(spark, sf).select(
        "id", "raw_predicted_points", "predicted_points", "price_m", "value", "price_signal"
    )
    return t.rounded(out, ["raw_predicted_points"])


@query(
    "all_ranked",
    "SCR7 SRT2 PRJ2 PRJ4",
    sql_with(*SQL_FORECAST)
    + f"""SELECT id, web_name AS "Player", {SQL_LABEL} AS "Pos", price_m AS "Price(£m)", fdr AS "FDR",
      is_home AS "Home", num_fixtures AS "Fixtures", avg_min AS "AvgMin(L5)", avail AS "AvailScore",
      {s6("raw1")} AS "RawPts", pred AS "PredPts", value AS "Value", form AS "AvgPts(L5)", signal AS "PriceSignal"
    FROM forecast""",
)
def all_ranked(spark, sf):
    return t.rounded(scoring.all_ranked(_forecast(spark, sf), keep_key=True), ["RawPts"])


@query(
    "best_by_group",
    "SCR7 SRT3 WIN9",
    sql_with(*SQL_FORECAST)
    + f"""SELECT CAST(row_number() OVER (PARTITION BY element_type ORDER BY pred DESC, id) AS INTEGER) AS "Rank",
      web_name AS "Player", {SQL_LABEL} AS "Pos", price_m AS "Price(£m)", fdr AS "FDR",
      is_home AS "Home", num_fixtures AS "Fixtures", avg_min AS "AvgMin(L5)", avail AS "AvailScore",
      {s6("raw1")} AS "RawPts", pred AS "PredPts", value AS "Value", form AS "AvgPts(L5)", signal AS "PriceSignal"
    FROM forecast WHERE element_type <= 4 QUALIFY "Rank" <= 10""",
)
def best_by_group(spark, sf):
    return t.rounded(scoring.best_by_group(_forecast(spark, sf)), ["RawPts"])


@query(
    "price_signals_table",
    "SCR7",
    sql_with(*SQL_FORECAST)
    + f"""SELECT web_name AS "Player", {SQL_LABEL} AS "Pos", price_m AS "Price(£m)", {s6("momentum")} AS "Momentum",
      form AS "AvgPts(L5)", signal AS "PriceSignal" FROM forecast""",
)
def price_signals_table(spark, sf):
    return t.rounded(scoring.price_signals(_forecast(spark, sf)), ["Momentum"])


@query(
    "form_report",
    "SRC4 RSH2 WIN1 JOI6 SC9 SRT3",
    sql_with(t.SQL_PANEL, t.SQL_PLAYERS, t.SQL_MOMENTUM,
             f"f AS (SELECT player_id, event, {s6(f'avg(total_points) OVER {FRAME5}')} AS form FROM panel)")
    + f"""SELECT CAST(row_number() OVER (PARTITION BY element_type ORDER BY form DESC, player_id) AS INTEGER) AS "Rank",
      web_name AS "Player", element_type AS "Pos", form AS "AvgPts(L5)",
      CASE WHEN momentum > 0.3 AND form > 4 THEN '{fixed.SIGNAL_RISE}'
        WHEN momentum < -0.3 OR form < 1 THEN '{fixed.SIGNAL_FALL}' ELSE '{fixed.SIGNAL_STABLE}' END AS "PriceSignal"
    FROM f JOIN players USING (player_id) JOIN momentum USING (player_id)
    WHERE event = (SELECT max(event) FROM periods) QUALIFY "Rank" <= 10""",
)
def form_report(spark, sf):
    """Flagship: the ten best per group by lagged form on the last day, with price signal."""
    spec = windows.timeline("player_id", "event")
    form = t.r6(windows.lag_mean("total_points", fixed.SHORT_WINDOW, spec))
    rolled = t.panel(spark, sf).select("player_id", "event", form.alias("form"))
    latest = clean.at_period(rolled, t.last_day(spark, sf))
    people = t.entities(spark, sf)
    named = joins.attach(latest, people, {"player_id": "id"}, ["web_name", "element_type"])
    moved = joins.attach(named, features.momentum(people), {"player_id": "id"})
    top = ranking.top_per_group(moved, "element_type", "form", fixed.REPORT_TOP, ["player_id"])
    return top.select(
        "Rank",
        F.col("web_name").alias("Player"),
        F.col("element_type").alias("Pos"),
        F.col("form").alias("AvgPts(L5)"),
        scalars.price_signal("transfer_momentum_norm", "form").alias("PriceSignal"),
    )


# --- validation -------------------------------------------------------------

SQL_SCORED = (
    *SQL_FEATURED,
    "scored AS (SELECT player_id, event, element_type, total_points, form AS predicted FROM featured "
    "WHERE form IS NOT NULL)",
)


def _scored(spark, sf):
    spec = windows.timeline("player_id", "event")
    form = t.r6(windows.lag_mean("total_points", 5, spec)).alias("predicted")
    rows = t.panel(spark, sf).select("player_id", "event", "total_points", form)
    group = t.players(spark, sf).select("player_id", "element_type")
    return joins.attach(clean.require(rows, ["predicted"]), group, "player_id")


@query(
    "validation_summary",
    "AGG2 AGG6 JOI8 SC4 SC22 PRJ4 SCR7",
    sql_with(*SQL_SCORED)
    + f"""SELECT web_name AS "Player", {SQL_LABEL.replace("element_type", "s.element_type")} AS "Pos", count(*) AS "GWsEval",
      {rint("round(avg(total_points), 6)", 2)} AS "AvgActualPts", {rint("round(avg(predicted), 6)", 2)} AS "AvgPredPts",
      {rint("round(avg(abs(predicted - total_points)), 6)", 3)} AS "MAE"
    FROM scored s JOIN players p USING (player_id) GROUP BY web_name, s.element_type, player_id""",
)
def validation_summary(spark, sf):
    scored = _scored(spark, sf)
    summary = aggregates.validation_summary(
        scored, "player_id", "element_type", "event", "total_points", "predicted"
    )
    # the means are rounded once before the half-even rounding so that float noise cannot move a tie
    noise_free = t.rounded(summary, ["actual_avg", "predicted_avg", "mae"])
    out = joins.attach(noise_free, t.entities(spark, sf), {"player_id": "id"}, ["web_name"])
    digits = {"actual_avg": 2, "predicted_avg": 2, "mae": 3}
    out = out.withColumns({c: scalars.round_half_even(c, d) for c, d in digits.items()})
    out = out.withColumn("element_type", scalars.map_codes("element_type"))
    return clean.rename_map(clean.select_present(out, list(fixed.VALIDATION_HEADERS)), fixed.VALIDATION_HEADERS)


@query(
    "mae_by_group",
    "AGG6 SC22",
    sql_with(*SQL_SCORED)
    + f"""SELECT element_type, {s6("avg(abs(predicted - total_points))")} AS mae, count(*) AS n_rows
    FROM scored GROUP BY 1""",
)
def mae_by_group(spark, sf):
    return t.rounded(
        aggregates.mae_by_group(_scored(spark, sf), "element_type", "total_points", "predicted"), ["mae"]
    )


@query(
    "macro_mae",
    "AGG6",
    sql_with(*SQL_SCORED)
    + f"""SELECT {s6("avg(mae)")} AS macro_mae FROM (SELECT avg(abs(predicted - total_points)) AS mae
    FROM scored GROUP BY element_type)""",
)
def macro_mae(spark, sf):
    maes = aggregates.mae_by_group(_scored(spark, sf), "element_type", "total_points", "predicted")
    return t.rounded(aggregates.macro_mae(maes), ["macro_mae"])


@query(
    "training_summary",
    "SNK5 AGG6 AGG7 MLP1",
    sql_with(*SQL_SCORED)
    + """, cal AS (SELECT event, row_number() OVER (ORDER BY event) AS i, count(*) OVER () AS n FROM periods),
      b AS (SELECT min(event) AS first_period, max(event) AS last_period, max(n) AS n_periods,
        greatest(1, round_even(max(n) * 0.8::DOUBLE, 0)) AS k FROM cal),
      cut AS (SELECT cal.event AS e FROM cal, b WHERE i = k),
      c AS (SELECT count(*) FILTER (WHERE event <= e)::DOUBLE AS tr, count(*) FILTER (WHERE event > e)::DOUBLE AS va
        FROM scored, cut),
      m AS (SELECT element_type, avg(abs(predicted - total_points)) AS mae FROM scored GROUP BY 1)
    SELECT metric, grp, CAST(round(value, 6) AS DOUBLE) AS value FROM (
      SELECT 'first_period' AS metric, 'all' AS grp, first_period::DOUBLE AS value FROM b
      UNION ALL SELECT 'last_period', 'all', last_period FROM b
      UNION ALL SELECT 'n_periods', 'all', n_periods FROM b
      UNION ALL SELECT 'n_train_periods', 'all', k FROM b
      UNION ALL SELECT 'n_val_periods', 'all', n_periods - k FROM b
      UNION ALL SELECT 'n_train', 'all', tr FROM c UNION ALL SELECT 'n_val', 'all', va FROM c
      UNION ALL SELECT 'train_pct', 'all', 100 * tr / (tr + va) FROM c
      UNION ALL SELECT 'val_pct', 'all', 100 * va / (tr + va) FROM c
      UNION ALL SELECT 'mae', element_type::VARCHAR, mae FROM m
      UNION ALL SELECT 'macro_mae', 'all', avg(mae) FROM m)""",
)
def training_summary(spark, sf):
    days = t.periods(spark, sf)
    scored = split.temporal_split(_scored(spark, sf), days)
    maes = aggregates.mae_by_group(scored, "element_type", "total_points", "predicted")
    report = sinks.training_summary(
        aggregates.split_counts(scored), maes, split.period_bounds(days), "element_type"
    )
    return t.rounded(report, ["value"])


# --- trace ------------------------------------------------------------------


@query(
    "entity_trace_score",
    "SCR8 FLT7",
    sql_with(*SQL_FORECAST)
    + f"""SELECT id, web_name, avg_min AS avg_minutes_last5, avail AS availability_score, fdr, is_home, num_fixtures,
      {s6("raw1")} AS raw_predicted_points, pred AS predicted_points FROM forecast
    WHERE lower(web_name) LIKE '%customer#00000000%' ORDER BY id LIMIT 1""",
)
def entity_trace_score(spark, sf):
    """The entity is found first; the facts of others but its opponents are dropped before they are added up."""
    name = "CUSTOMER#00000000"
    ids = materialise(scoring.find_entity(t.players(spark, sf), "web_name", name, "player_id"), "traced")
    hit, _ = scoring.entity_trace(_forecast(spark, sf, ids), t.panel(spark, sf, ids), t.periods(spark, sf), name)
    return t.rounded(hit, ["raw_predicted_points"]).select(
        "id", "web_name", "avg_minutes_last5", "availability_score", "fdr", "is_home", "num_fixtures",
        "raw_predicted_points", "predicted_points",
    )


@query(
    "entity_trace_periods",
    "SCR8 FLT6 FLT7 SRT5",
    sql_with(t.SQL_PANEL)
    + """SELECT event AS "GW", total_points AS "Pts", minutes AS "Min", goals_scored AS "GS", assists AS "Ast",
      clean_sheets AS "CS" FROM panel
    WHERE player_id = (SELECT min(c_custkey) FROM customer WHERE c_name LIKE '%00000001%')
      AND event IN (SELECT event FROM periods ORDER BY event DESC LIMIT 5)""",
)
def entity_trace_periods(spark, sf):
    ids = materialise(scoring.find_entity(t.players(spark, sf), "web_name", "00000001", "player_id"), "traced")
    _, last = scoring.entity_trace(t.entities(spark, sf), t.panel(spark, sf, ids), t.periods(spark, sf), "00000001")
    return last


# --- models -----------------------------------------------------------------

QUERY_SETTINGS = models.Boosting()


def _training(spark, sf, rolled=None):
    """Training rows, written by group, and the feature names of each group that the rows have.

    rolled: the rolled panel, if written already.
    """
    rolled = features.rolled_panel(t.active_panel(spark, sf)) if rolled is None else rolled
    rows = features.with_attributes(rolled, t.entities(spark, sf))
    first = t.periods(spark, sf).agg(F.min("event")).scalar()
    needed = [c for c in features.common_features() if c in rows.columns] + ["total_points"]
    learn = split.training_set(rows, first, needed)
    learn = split.temporal_split(learn, t.periods(spark, sf))
    learn = materialise(split.clip_target(learn, "total_points", "element_type"), "training", ["element_type"])
    groups = learn.filter(F.col("element_type").isNotNull()).select("element_type").distinct().collect()
    return learn, {g: features.feature_columns(g, learn.columns) for (g,) in sorted(groups)}


def _trial(spark, sf):
    """The training rows and the models learned from the first part of the periods."""
    learn, names = _training(spark, sf)
    held_in = learn.filter("split = 'train'")
    return learn, models.fit_per_group(held_in, "element_type", names, "total_points", QUERY_SETTINGS)


@query("gbt_validation", "MLP2 MLP5 MLP6 MLP8 AGG6")
def gbt_validation(spark, sf):
    """Hold-out error per group of the boosted trees."""
    learn, fitted = _trial(spark, sf)
    _, maes = models.validate(fitted, learn.filter("split = 'val'"), "element_type", "total_points")
    return maes


@query(
    "gbt_validation_checks",
    "MLP5 MLP6 MLP8",
    sql_with(*SQL_FEATURED, SQL_SPLIT.replace("SELECT DISTINCT event FROM matches WHERE finished", "SELECT event FROM periods"))
    + """, learn AS (SELECT element_type, event <= (SELECT event FROM cal, bounds WHERE i = n_train) AS held_in FROM featured
      WHERE event > (SELECT min(event) FROM periods) AND minutes_mean5 > 1 AND xgi_last IS NOT NULL)
    SELECT element_type, count(*) FILTER (WHERE held_in) AS n_train, count(*) FILTER (WHERE NOT held_in) AS n_val,
      count(*) FILTER (WHERE NOT held_in) AS n_scored, TRUE AS learned FROM learn
    GROUP BY 1 HAVING count(*) FILTER (WHERE held_in) > 0""",
)
def gbt_validation_checks(spark, sf):
    """What is certain of the fits: rows learned from and scored, and that each group's model learned something.

    A model has learned if its mean error on its own rows is below that of their mean.
    """
    learn, fitted = _trial(spark, sf)
    scored = fitted.predict(learn, "element_type")
    held_in, held_out = F.col("split") == "train", F.col("split") == "val"
    mean = {g: m.base for g, m in fitted.models.items()}
    error, plain = F.abs(F.col("predicted") - F.col("total_points")), F.abs(scalars.lookup("element_type", mean) - F.col("total_points"))
    return scored.groupBy("element_type").agg(
        F.count_if(held_in).alias("n_train"),
        F.count_if(held_out).alias("n_val"),
        F.count_if(held_out & (F.col("predicted") >= 0)).alias("n_scored"),
        (F.avg(F.when(held_in, error)) < F.avg(F.when(held_in, plain))).alias("learned"),
    )


def _predicted(spark, sf):
    """The forecast of the day after by models refitted on all rows."""
    rolled, blank = _rolled(spark, sf)
    rolled = materialise(rolled, "rolled")  # the rows to learn from and those of the last day
    learn, names = _training(spark, sf, rolled)
    fitted = models.fit_per_group(learn, "element_type", names, "total_points", QUERY_SETTINGS)
    frame = materialise(_snapshot(spark, sf, rolled=(rolled, blank)), "frame", ["element_type"])
    return scoring.adjust_predictions(models.score_groups(fitted, frame, "element_type"))


@query("gbt_per_group", "MLP5 MLP7 MLP8 SCR5 JOI10")
def gbt_per_group(spark, sf):
    """Refit on all rows and the forecast of the day after, by the fitted models."""
    out = _predicted(spark, sf)
    return out.select("id", "element_type", "raw_predicted_points", "predicted_points", "value")


@query(
    "gbt_forecast_checks",
    "MLP7 SCR5 SCR6",
    sql_with(*SQL_FORECAST)
    + """SELECT id, element_type, num_fixtures, avail AS availability_score, TRUE AS in_range, TRUE AS idle_is_zero,
      TRUE AS consistent FROM forecast""",
)
def gbt_forecast_checks(spark, sf):
    """The business rules on each forecast of the fitted models: caps, no points without a match, final points."""
    raw, doubled = F.col("raw_predicted_points"), F.col("num_fixtures") >= 2
    cap = scalars.lookup("element_type", {k: float(v) for k, v in fixed.PREDICTION_CAP.items()})
    # the caps are for the groups that have one; two matches have a cap of their own
    below = cap.isNull() | (raw <= F.when(doubled, float(fixed.DOUBLE_CAP)).otherwise(cap))
    final = F.abs(F.col("predicted_points") - raw * F.col("availability_score")) <= 0.005 + 1e-9
    return _predicted(spark, sf).select(
        "id", "element_type", "num_fixtures", "availability_score",
        (raw.isNotNull() & (raw >= 0) & below).alias("in_range"),
        ((F.col("num_fixtures") > 0) | (raw == 0)).alias("idle_is_zero"),
        final.alias("consistent"),
    )
