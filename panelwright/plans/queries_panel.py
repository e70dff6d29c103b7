"""Registered queries: cleaning, filters, joins, reshaping, aggregates, windows, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import scalars, text, windows
from panelwright.operators import aggregates, clean, features, joins, order_stats, panel, ranking, split
from panelwright.plans import tables as t
from panelwright.plans.registry import query
from panelwright.plans.tables import rint, s6, sql_sides, sql_with
from panelwright.sources.feeds import finished_periods

FRAME5 = "(PARTITION BY player_id ORDER BY event ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
FRAME19 = "(PARTITION BY player_id ORDER BY event ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)"

# --- projections and cleaning -----------------------------------------------


@query(
    "select_rename",
    "PRJ1 PRJ2",
    """SELECT c_custkey AS "Id", c_name AS "Player", c_mktsegment AS "Pos", c_acctbal AS "Balance"
    FROM customer""",
)
def select_rename(spark, sf):
    names = {"c_custkey": "Id", "c_name": "Player", "c_mktsegment": "Pos", "c_acctbal": "Balance"}
    shown = clean.select_present(t.table(spark, sf, "customer"), [*names, "c_missing"])
    return clean.rename_map(shown, names)


@query(
    "clean_columns",
    "SC1 PRJ3 RSH6 RSH7",
    f"""SELECT event_id, {t.SQL_DAY} AS event,
      coalesce(CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
        ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 0.0::DOUBLE) AS saves,
      value AS bonus, 0.0::DOUBLE AS own_goals, 'n/a' AS news
    FROM events""",
)
def clean_columns(spark, sf):
    k = F.get_json_object("props", "$.k")
    bad = F.col("event_id") % 10
    raw = t.table(spark, sf, "events").select(
        "event_id",
        t.day("ts").alias("event"),
        F.when(bad == 0, "abc").when(bad == 1, F.concat(k, F.lit("d"))).when(bad != 2, k).alias("saves"),
        F.col("value").cast("string").alias("bonus"),
    )
    raw = clean.first_present(raw, ["round", "event"], "event")
    raw = clean.numeric_columns(raw, ["saves", "bonus", "own_goals"], default=0.0)
    return clean.fill_defaults(clean.ensure_columns(raw, ["news"], "n/a"), {"saves": 0.0})


@query(
    "map_codes",
    "PRJ4",
    """SELECT s_suppkey, CASE s_nationkey % 6 WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID'
      WHEN 4 THEN 'FWD' ELSE '?' END AS pos FROM supplier""",
)
def map_codes(spark, sf):
    code = F.col("s_nationkey") % 6
    return t.table(spark, sf, "supplier").select("s_suppkey", scalars.map_codes(code).alias("pos"))


@query(
    "canonical_code",
    "PRJ5 SC14",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID'
      WHEN 3 THEN 'FWD' WHEN 4 THEN 'FWD' END AS pos FROM orders WHERE o_orderkey % 6 <> 5""",
)
def canonical_code(spark, sf):
    spellings = F.array(*map(F.lit, ["goalkeeper", "Def", "MIDfielder", "attacker", "Fwd", "coach"]))
    spelled = t.table(spark, sf, "orders").select(
        "o_orderkey", F.get(spellings, (F.col("o_orderkey") % 6).cast("int")).alias("pos")
    )
    return clean.canonical_groups(spelled, "pos", fixed.POSITION_ALIASES)


@query(
    "value_ratio",
    "PRJ6 SC4",
    f"""SELECT p_partkey, {rint("p_retailprice / greatest(p_size / 100.0::DOUBLE, 0.1::DOUBLE)", 3)}
      AS value FROM part""",
)
def value_ratio(spark, sf):
    ratio = scalars.value_ratio("p_retailprice", F.col("p_size") / 100.0)
    return t.table(spark, sf, "part").select(
        "p_partkey", scalars.round_half_even(ratio, 3).alias("value")
    )


# --- filters ----------------------------------------------------------------


@query(
    "only_true",
    "FLT1",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 IN (0, 1)",
)
def only_true(spark, sf):
    flags = F.array(*map(F.lit, ["True", "true", "False"]), F.lit(None).cast("string"))
    flagged = t.table(spark, sf, "orders").select(
        "o_orderkey", F.get(flags, (F.col("o_orderkey") % 4).cast("int")).alias("finished")
    )
    return clean.only_true(flagged, "finished").select("o_orderkey")


@query(
    "at_period",
    "FLT2",
    sql_with(t.SQL_PANEL)
    + "SELECT player_id, total_points FROM panel WHERE event = (SELECT max(event) FROM periods)",
)
def at_period(spark, sf):
    rows = clean.at_period(t.panel(spark, sf), t.last_day(spark, sf))
    return rows.select("player_id", "total_points")


@query(
    "after_period",
    "FLT3",
    sql_with(t.SQL_PANEL)
    + "SELECT player_id, event, minutes FROM panel WHERE event > (SELECT min(event) FROM periods)",
)
def after_period(spark, sf):
    first = t.periods(spark, sf).agg(F.min("event")).scalar()
    return clean.after_period(t.panel(spark, sf), first).select("player_id", "event", "minutes")


@query(
    "active_only",
    "FLT4",
    sql_with(
        t.SQL_PANEL,
        f"rolled AS (SELECT player_id, event, avg(minutes) OVER {FRAME5} AS m FROM panel)",
    )
    + f"SELECT player_id, event, {s6('m')} AS minutes_mean5 FROM rolled WHERE m > 1",
)
def active_only(spark, sf):
    spec = windows.timeline("player_id", "event")
    rolled = t.panel(spark, sf).select(
        "player_id", "event", windows.lag_mean("minutes", 5, spec).alias("minutes_mean5")
    )
    return t.rounded(clean.active_only(rolled, "minutes_mean5", 1), ["minutes_mean5"])


@query(
    "require_columns",
    "FLT5",
    sql_with(t.SQL_PRODUCTS)
    + "SELECT id, form, share FROM products WHERE form IS NOT NULL AND share IS NOT NULL",
)
def require_columns(spark, sf):
    return clean.require(t.products(spark, sf), ["form", "share", "absent"]).select("id", "form", "share")


@query(
    "member_of",
    "FLT6",
    """SELECT c_custkey, c_mktsegment FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT user_id FROM events)""",
)
def member_of(spark, sf):
    known = clean.member_of(
        t.table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]
    )
    users = t.table(spark, sf, "events").select("user_id")
    return clean.member_of(known, "c_custkey", users).select("c_custkey", "c_mktsegment")


@query(
    "name_search",
    "FLT7 SC15",
    "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%gear%' OR p_name LIKE '%bolt%'",
)
def name_search(spark, sf):
    part = t.table(spark, sf, "part").select("p_partkey", "p_name")
    return clean.name_search(part, "p_name", "GEAR|Bolt")


@query("positive", "FLT8", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def positive(spark, sf):
    return clean.positive(t.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


# --- joins ------------------------------------------------------------------


@query(
    "attach_dimension",
    "JOI1 JOI5 JOI6",
    sql_with(t.SQL_FACTS, t.SQL_PLAYERS)
    + """SELECT player_id, event, minutes, element_type, team, now_cost
    FROM facts LEFT JOIN players USING (player_id)""",
)
def attach_dimension(spark, sf):
    facts = t.facts(spark, sf).select("player_id", "event", "minutes")
    dim = t.players(spark, sf).withColumnRenamed("player_id", "id")
    return joins.attach(facts, dim, {"player_id": "id"}, ["element_type", "team", "now_cost"])


@query(
    "attach_salted",
    "JOI1",
    "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id",
)
def attach_salted(spark, sf):
    events = t.table(spark, sf, "events").select("event_id", "user_id")
    dim = t.table(spark, sf, "customer")
    out = joins.attach(
        events, dim, {"user_id": "c_custkey"}, ["c_mktsegment"], salt=8, salt_by=["event_id"]
    )
    return out.drop("user_id")


@query(
    "attach_split",
    "JOI1 JOI2",
    """SELECT event_id, who, c_mktsegment FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS who
      FROM events) LEFT JOIN customer ON c_custkey = who""",
)
def attach_split(spark, sf):
    """A dimension joined to events a third of which have one key; the join finds that key itself."""
    who = F.when(F.col("event_id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("user_id")).alias("who")
    events = t.table(spark, sf, "events").select("event_id", who)
    return joins.attach_split(events, t.table(spark, sf, "customer"), {"who": "c_custkey"}, ["c_mktsegment"])


@query(
    "side_context_join",
    "JOI2",
    sql_with(t.SQL_FACTS, t.SQL_PLAYERS, t.SQL_CONTEXT, t.SQL_MATCH_PANEL)
    + """SELECT player_id, event, team, total_points, fdr, is_home, score_for, score_ag FROM history""",
)
def side_context_join(spark, sf):
    return t.history(spark, sf).select(
        "player_id", "event", "team", "total_points", "fdr", "is_home", "score_for", "score_ag"
    )


@query(
    "join_suffixed",
    "JOI3",
    sql_with(t.SQL_FACTS)
    + """SELECT f.player_id, f.event, f.minutes, f.saves, c.c_custkey AS id,
      floor(c.c_acctbal) AS minutes_season, CAST(c.c_nationkey AS DOUBLE) AS saves_season
    FROM facts f LEFT JOIN customer c ON c.c_custkey = f.player_id""",
)
def join_suffixed(spark, sf):
    totals = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.floor("c_acctbal").cast("double").alias("minutes"),
        F.col("c_nationkey").cast("double").alias("saves"),
    )
    facts = t.facts(spark, sf).select("player_id", "event", "minutes", "saves")
    return joins.join_suffixed(facts, totals, "player_id", "id")


@query(
    "join_latest",
    "JOI11",
    sql_with(
        t.SQL_CALENDAR_MATCHES,
        sql_sides("calendar"),
        "latest AS (SELECT team, arg_max(score, event) AS score FROM (SELECT team, event, "
        "avg(score_ag) AS score FROM sides WHERE team < 20 GROUP BY 1, 2) GROUP BY 1)",
    )
    + f"""SELECT c_custkey, c_nationkey, {s6("coalesce(score, 1.0::DOUBLE)")} AS strength
    FROM customer LEFT JOIN latest ON team = c_nationkey""",
)
def join_latest(spark, sf):
    sides = panel.unpivot_sides(t.calendar_matches(spark, sf)).filter("team < 20")
    series = aggregates.mean_by(sides, ["team", "event"], "score_ag", "strength")
    customer = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    out = joins.join_latest(customer, series, {"c_nationkey": "team"}, "event", "strength", 1.0)
    return t.rounded(out, ["strength"])


@query(
    "missing_keys",
    "JOI12 SET2",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def missing_keys(spark, sf):
    seen = t.table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return joins.missing_keys(t.table(spark, sf, "customer"), seen, "c_custkey")


@query(
    "restrict_to",
    "JOI13",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""",
)
def restrict_to(spark, sf):
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = t.table(spark, sf, "part").filter("p_type = 'PROMO'")
    keys = keys.select(F.col("p_partkey").alias("l_partkey"))
    out = joins.restrict_to(lines, keys, "l_partkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "union_all",
    "SET1",
    """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def union_all(spark, sf):
    buyers = t.table(spark, sf, "customer").selectExpr(
        "c_custkey id", "c_acctbal balance", "c_mktsegment segment"
    )
    sellers = t.table(spark, sf, "supplier").selectExpr("s_acctbal balance", "s_suppkey id")
    return joins.union_all(buyers, sellers)


@query(
    "except_keys",
    "SET2",
    """SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 500
    EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""",
)
def except_keys(spark, sf):
    a = t.table(spark, sf, "customer").filter("c_acctbal < 500").selectExpr("c_nationkey nation")
    b = t.table(spark, sf, "supplier").filter("s_acctbal > 5000").selectExpr("s_nationkey nation")
    return joins.except_keys(a, b)


# --- reshape ----------------------------------------------------------------


@query("complete_panel", "JOI4 JOI14 RSH2 RSH6", sql_with(t.SQL_PANEL) + "SELECT * FROM panel")
def complete_panel(spark, sf):
    return t.panel(spark, sf)


@query(
    "grid_spread",
    "JOI14",
    f"""SELECT c_custkey AS player_id, event FROM customer,
      (SELECT DISTINCT {t.SQL_DAY} AS event FROM events)""",
)
def grid_spread(spark, sf):
    ids = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"))
    return panel.replicated_grid(ids, t.periods(spark, sf), "player_id")


@query(
    "first_per_key",
    "RSH3 SRT1",
    f"""SELECT user_id AS player_id, {t.SQL_DAY} AS event, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, {t.SQL_DAY} ORDER BY ts, event_id) = 1""",
)
def first_per_key(spark, sf):
    events = t.table(spark, sf, "events").select(
        F.col("user_id").alias("player_id"),
        t.day("ts").alias("event"),
        "ts",
        "event_id",
        "event_type",
        "value",
    )
    return panel.first_per_key(events, ["player_id", "event"], ["ts", "event_id"]).drop("ts")


@query(
    "best_per_key",
    "RSH4",
    sql_with(t.SQL_MATCHES, sql_sides("matches"))
    + """SELECT team, event, fixture_id, fdr, is_home FROM sides QUALIFY row_number() OVER
      (PARTITION BY team, event ORDER BY fdr, is_home DESC, fixture_id) = 1""",
)
def best_per_key(spark, sf):
    sides = panel.unpivot_sides(t.matches(spark, sf), keep=["fixture_id"])
    order = [F.col("fdr").asc_nulls_last(), F.col("is_home").desc(), F.col("fixture_id")]
    best = panel.first_per_key(sides, ["team", "event"], order)
    return best.select("team", "event", "fixture_id", "fdr", "is_home")


@query(
    "unpivot_sides",
    "RSH1 SC2",
    sql_with(t.SQL_MATCHES, sql_sides("matches"))
    + """SELECT event, fixture_id, team, opponent, fdr, is_home, score_for, score_ag FROM sides
    WHERE finished""",
)
def unpivot_sides(spark, sf):
    finished = clean.only_true(t.matches(spark, sf), "finished")
    return panel.unpivot_sides(finished, keep=["fixture_id"])


@query(
    "mirror_sides",
    "JOI15",
    sql_with(t.SQL_MATCHES)
    + """SELECT fixture_id, team_h AS team, team_a AS opp_team, team_h_score AS score,
      team_a_score AS opp_score, 1.0::DOUBLE AS is_home FROM matches
    UNION ALL SELECT fixture_id, team_a, team_h, team_a_score, team_h_score, 0.0::DOUBLE FROM matches""",
)
def mirror_sides(spark, sf):
    pairs = {"team": ("team_h", "team_a"), "score": ("team_h_score", "team_a_score")}
    return panel.mirror_sides(t.matches(spark, sf), pairs, keep=["fixture_id"])


@query(
    "concat_columns",
    "RSH5",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS saved,
      l_quantity * 2 AS twice FROM lineitem""",
)
def concat_columns(spark, sf):
    lines = t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"
    )
    block = {
        "saved": F.round(F.col("l_extendedprice") * F.col("l_discount"), 4),
        "twice": F.col("l_quantity") * 2,
    }
    wide = clean.concat_columns(lines, block)
    return wide.select("l_orderkey", "l_linenumber", "saved", "twice")


# --- aggregates -------------------------------------------------------------


@query(
    "mean_by",
    "AGG1",
    sql_with(t.SQL_MATCHES, sql_sides("matches"))
    + f"""SELECT team, event, {s6("avg(score_ag)")} AS conceded FROM sides GROUP BY 1, 2""",
)
def mean_by(spark, sf):
    sides = panel.unpivot_sides(t.matches(spark, sf))
    return t.rounded(aggregates.mean_by(sides, ["team", "event"], "score_ag", "conceded"), ["conceded"])


@query("entity_count", "AGG3", "SELECT count(DISTINCT user_id) AS n_entities FROM events")
def entity_count(spark, sf):
    return aggregates.entity_count(t.table(spark, sf, "events"), "user_id")


@query(
    "distinct_periods",
    "AGG4",
    "SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS event FROM orders",
)
def distinct_periods(spark, sf):
    months = t.table(spark, sf, "orders").select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("event")
    )
    return aggregates.distinct_periods(months)


@query(
    "finished_periods",
    "SRC8 FLT1",
    sql_with(t.SQL_MATCHES)
    + """SELECT event, bool_and(finished) AS complete FROM matches GROUP BY 1 HAVING bool_or(finished)""",
)
def finished_periods_query(spark, sf):
    fixtures = t.matches(spark, sf)
    done = finished_periods(fixtures, complete=True).withColumn("complete", F.lit(True))
    some = finished_periods(fixtures)
    return joins.attach(some, done, "event", fills={"complete": False})


@query(
    "max_abs",
    "AGG5 SC22",
    "SELECT s_suppkey, round(s_acctbal / (SELECT max(abs(s_acctbal)) FROM supplier), 6) AS share FROM supplier",
)
def max_abs(spark, sf):
    supplier = t.table(spark, sf, "supplier")
    share = F.col("s_acctbal") / aggregates.max_abs(supplier, "s_acctbal")
    return supplier.select("s_suppkey", F.round(share, 6).alias("share"))


@query(
    "count_in_group",
    "AGG8 WIN11",
    sql_with(t.SQL_PRODUCTS) + 'SELECT id, "Pos", count(form) OVER (PARTITION BY "Pos") AS n FROM products',
)
def count_in_group(spark, sf):
    parts = t.products(spark, sf).select("id", "Pos", "form")
    return aggregates.count_in_group(parts, "form", "Pos", "n").drop("form")


@query(
    "last_non_null",
    "AGG9",
    sql_with(t.SQL_FACTS)
    + """SELECT player_id, arg_max(nullif(goals_scored, 0), event) FILTER (WHERE goals_scored <> 0)
      AS goals_scored, arg_max(nullif(clean_sheets, 0), event) FILTER (WHERE clean_sheets <> 0)
      AS clean_sheets FROM facts GROUP BY 1""",
)
def last_non_null(spark, sf):
    facts = t.facts(spark, sf).select(
        "player_id",
        "event",
        *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("goals_scored", "clean_sheets")],
    )
    return aggregates.last_non_null(facts, "player_id", "event", ["goals_scored", "clean_sheets"])


@query(
    "column_stats",
    "AGG10",
    f"""SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS min,
      max(l_extendedprice) AS max, round(stddev_pop(l_extendedprice), 4) AS std,
      {s6("median(l_extendedprice)")} AS median, {s6("quantile_cont(l_extendedprice, 0.88)")} AS p
    FROM lineitem GROUP BY 1""",
)
def column_stats(spark, sf):
    lines = t.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    stats = aggregates.column_stats(lines, "l_extendedprice", ["l_returnflag"])
    return t.rounded(stats, ["median", "p"]).withColumn("std", F.round("std", 4))


@query(
    "global_percentiles",
    "AGG10",
    "SELECT share, round(CASE share "
    + " ".join(
        f"WHEN {s} THEN (SELECT quantile_cont(o_totalprice, {s}) FROM orders)" for s in (0.0, 0.25, 0.5, 0.99, 1.0)
    )
    + " END, 4) AS value FROM (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.99, 1.0]) AS share)",
)
def global_percentiles(spark, sf):
    orders = t.table(spark, sf, "orders")
    out = aggregates.group_percentiles(orders, "o_totalprice", [], [0.0, 0.25, 0.5, 0.99, 1.0])
    return out.withColumn("value", F.round("value", 4))


@query(
    "join_lines",
    "AGG11",
    """SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text
    FROM nation GROUP BY 1""",
)
def join_lines(spark, sf):
    nation = t.table(spark, sf, "nation")
    return aggregates.join_lines(nation, "n_name", ["n_nationkey"], ["n_regionkey"])


# --- windows ----------------------------------------------------------------


def _rolled_sql(stats) -> str:
    cols = []
    for s in stats:
        mean5, mean19 = f"avg({s}) OVER {FRAME5}", f"avg({s}) OVER {FRAME19}"
        cols += [
            f"{s6(mean5)} AS {s}_mean5",
            f"{s6(f'sum({s}) OVER {FRAME5}')} AS {s}_sum5",
            f"round(coalesce(stddev_samp({s}) OVER {FRAME5}, 0.0::DOUBLE), 4) AS {s}_std5",
            f"{s6(mean19)} AS {s}_mean19",
            f"{s6(f'{mean5} - {mean19}')} AS {s}_trend",
        ]
    return "SELECT player_id, event, " + ", ".join(cols) + " FROM panel"


def _ewm_sql(stats) -> str:
    cols = [
        s6(f"sum(b.{s} * power(2.0::DOUBLE / 3, a.event - b.event)) "
           "/ sum(power(2.0::DOUBLE / 3, a.event - b.event))") + f" AS {s}_ewm"
        for s in stats
    ]
    return f"""SELECT a.player_id, a.event, {", ".join(cols)} FROM panel a
    LEFT JOIN panel b ON a.player_id = b.player_id AND b.event < a.event GROUP BY 1, 2"""


@query(
    "rolling_lagged",
    "WIN1 WIN2 WIN3 WIN5 WIN6 RSH5 SRT1",
    sql_with(t.SQL_PANEL) + _rolled_sql(["total_points", "minutes", "saves"]),
)
def rolling_lagged(spark, sf):
    stats = ["total_points", "minutes", "saves"]
    rows = t.panel(spark, sf).select("player_id", "event", *stats)
    out = features.rolling_features(rows, "player_id", "event", stats, dense=True).drop(*stats)
    out = out.drop(*[f"{s}_ewm" for s in stats])
    deviations = {f"{s}_std5": F.round(f"{s}_std5", 4) for s in stats}
    others = [c for c in out.columns if c not in ("player_id", "event", *deviations)]
    return t.rounded(out, others).withColumns(deviations)


@query(
    "ewm_lagged",
    "WIN4",
    sql_with(t.SQL_PANEL) + _ewm_sql(["total_points", "goals_scored"]),
)
def ewm_lagged(spark, sf):
    stats = ["total_points", "goals_scored"]
    rows = t.panel(spark, sf).select("player_id", "event", *stats)
    out = features.ewm_features(rows, "player_id", "event", stats, dense=True).drop(*stats)
    return t.rounded(out, [f"{s}_ewm" for s in stats])


@query(
    "lag_last",
    "WIN7",
    sql_with(t.SQL_PANEL)
    + """SELECT player_id, event, lag(saves) OVER w AS saves_last, lag(assists) OVER w AS assists_last
    FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY event)""",
)
def lag_last(spark, sf):
    out = features.previous_values(t.panel(spark, sf), "player_id", "event", ["saves", "assists", "nope"])
    return out.select("player_id", "event", "saves_last", "assists_last")


@query(
    "rolling_current",
    "WIN1 WIN2",
    sql_with(t.SQL_PANEL)
    + f"""SELECT player_id, event, {s6("avg(saves) OVER w")} AS mean5, {s6("sum(saves) OVER w")} AS sum5
    FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY event ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rolling_current(spark, sf):
    spec = windows.timeline("player_id", "event")
    return t.panel(spark, sf).select(
        "player_id",
        "event",
        t.r6(windows.lag_mean("saves", 5, spec, include_current=True)).alias("mean5"),
        t.r6(windows.lag_sum("saves", 5, spec, include_current=True)).alias("sum5"),
    )


@query(
    "group_strength",
    "WIN8 AGG1",
    sql_with(
        t.SQL_MATCHES,
        sql_sides("matches"),
        "g AS (SELECT team, event, avg(score_ag) AS c FROM sides GROUP BY 1, 2)",
    )
    + f"""SELECT team, event, {s6("avg(c) OVER (PARTITION BY team ORDER BY event ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")}
      AS strength FROM g""",
)
def group_strength(spark, sf):
    sides = panel.unpivot_sides(t.matches(spark, sf))
    series = aggregates.mean_by(sides, ["team", "event"], "score_ag", "conceded")
    strength = windows.lag_mean("conceded", 5, windows.timeline("team", "event"))
    return series.select("team", "event", t.r6(strength).alias("strength"))


@query(
    "rank_in_group",
    "WIN9",
    """SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey
      ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 25""",
)
def rank_in_group(spark, sf):
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    customer = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    ranked = customer.withColumn("rank", windows.rank_in_group("c_nationkey", order))
    return ranked.filter("rank <= 25").drop("c_acctbal")


@query(
    "whole_ranks",
    "WIN9 SRT2",
    """SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank,
      row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank_overall FROM customer""",
)
def whole_ranks(spark, sf):
    """The place of every row in its group and overall, without a group or the table in one task."""
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    customer = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    grouped = order_stats.exact_ranks(customer, ["c_nationkey"], order)
    return order_stats.exact_ranks(grouped, [], order, "rank_overall").drop("c_acctbal")


@query(
    "many_percentiles",
    "AGG10",
    """SELECT l_returnflag, c AS column, share, round(CASE c WHEN 'l_extendedprice' THEN CASE share WHEN 0.05 THEN a1 WHEN 0.5 THEN a2 ELSE a3 END
      ELSE CASE share WHEN 0.05 THEN b1 WHEN 0.5 THEN b2 ELSE b3 END END, 4) AS value
    FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS a1, quantile_cont(l_extendedprice, 0.5) AS a2,
      quantile_cont(l_extendedprice, 0.99) AS a3, quantile_cont(l_quantity, 0.05) AS b1, quantile_cont(l_quantity, 0.5) AS b2,
      quantile_cont(l_quantity, 0.99) AS b3 FROM lineitem GROUP BY 1),
      (SELECT unnest([0.05::DOUBLE, 0.5, 0.99]) AS share), (SELECT unnest(['l_extendedprice', 'l_quantity']) AS c)""",
)
def many_percentiles(spark, sf):
    """Percentiles of several columns and shares in the same passes."""
    lines = t.table(spark, sf, "lineitem")
    out = order_stats.percentiles(lines, ["l_extendedprice", "l_quantity"], ["l_returnflag"], [0.05, 0.5, 0.99])
    return out.withColumn("value", F.round("value", 4))


# --- sorts ------------------------------------------------------------------


@query(
    "ranked",
    "SRT2",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
)
def ranked(spark, sf):
    return ranking.ranked(
        t.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"]
    )


@query(
    "top_per_group",
    "SRT3 WIN9",
    """SELECT p_partkey, p_type, p_retailprice, CAST(row_number() OVER (PARTITION BY p_type
      ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS "Rank" FROM part QUALIFY "Rank" <= 10""",
)
def top_per_group(spark, sf):
    part = t.table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    return ranking.top_per_group(part, "p_type", "p_retailprice", 10, ["p_partkey"])


LIMITS = {"ECONOMY": 20, "SMALL": 50, "MEDIUM": 60, "LARGE": 30}


@query(
    "top_by_limit",
    "SRT4",
    """SELECT p_partkey, p_type, p_size, CAST(row_number() OVER (PARTITION BY p_type
      ORDER BY p_size DESC, p_partkey) AS INTEGER) AS "Rank" FROM part
    QUALIFY "Rank" <= CASE p_type WHEN 'ECONOMY' THEN 20 WHEN 'SMALL' THEN 50 WHEN 'MEDIUM' THEN 60
      WHEN 'LARGE' THEN 30 END""",
)
def top_by_limit(spark, sf):
    part = t.table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    return ranking.top_by_limit(part, "p_type", "p_size", LIMITS, ["p_partkey"])


@query(
    "periods_head_tail",
    "SRT5",
    sql_with(t.SQL_FACTS)
    + """SELECT event, 'head' AS part FROM (SELECT event FROM periods ORDER BY event LIMIT 7)
    UNION ALL SELECT event, 'tail' FROM (SELECT event FROM periods ORDER BY event DESC LIMIT 5)""",
)
def periods_head_tail(spark, sf):
    days = t.periods(spark, sf)
    head = split.periods_head(days, 7).withColumn("part", F.lit("head"))
    tail = split.periods_tail(days, 5).withColumn("part", F.lit("tail"))
    return joins.union_all(head, tail)


# --- scalars ----------------------------------------------------------------


@query(
    "falsy_and_clip",
    "SC2 SC3",
    """SELECT event_id, coalesce(nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE) % 4, 0), 3.0::DOUBLE) AS fdr,
      least(greatest(value, 5.0::DOUBLE), 30.0::DOUBLE) AS both, greatest(value, 2.5::DOUBLE) AS low,
      least(value, 20.0::DOUBLE) AS high FROM events""",
)
def falsy_and_clip(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return t.table(spark, sf, "events").select(
        "event_id",
        scalars.falsy_default(k % 4, 3).alias("fdr"),
        scalars.clip("value", 5.0, 30.0).alias("both"),
        scalars.clip("value", low=2.5).alias("low"),
        scalars.clip("value", high=20.0).alias("high"),
    )


@query(
    "round_half_even",
    "SC4",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rint("l_extendedprice * l_discount", 2)} AS r2,
      {rint("l_quantity / 8", 2)} AS tie2, {rint("l_extendedprice / 7", 3)} AS r3 FROM lineitem""",
)
def round_half_even(spark, sf):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return t.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        scalars.round_half_even(price * F.col("l_discount"), 2).alias("r2"),
        scalars.round_half_even(quantity / 8, 2).alias("tie2"),
        scalars.round_half_even(price / 7, 3).alias("r3"),
    )


@query(
    "masked_and_update",
    "SC7 SC10",
    sql_with(t.SQL_PRODUCTS)
    + """SELECT id, form * CAST("Pos" IN ('SMALL', 'LARGE') AS INTEGER) AS small_form,
      CASE WHEN share > 20 THEN 0.0::DOUBLE ELSE share END AS share FROM products""",
)
def masked_and_update(spark, sf):
    return t.products(spark, sf).select(
        "id",
        scalars.masked("form", F.col("Pos").isin("SMALL", "LARGE")).alias("small_form"),
        scalars.update_where("share", F.col("share") > 20, 0.0).alias("share"),
    )


@query(
    "interaction_columns",
    "SC5",
    sql_with(t.SQL_FACTS, t.SQL_PLAYERS, t.SQL_CONTEXT, t.SQL_MATCH_PANEL,
             f"r AS (SELECT player_id, event, fdr, is_home, {s6(f'avg(total_points) OVER {FRAME5}')} AS m FROM match_panel)")
    + f"SELECT player_id, event, {s6('m * (6 - fdr)')} AS pts_x_fdr, {s6('is_home * m')} AS home_x_form FROM r",
)
def interaction_columns(spark, sf):
    spec = windows.timeline("player_id", "event")
    form = t.r6(windows.lag_mean("total_points", 5, spec)).alias("total_points_mean5")
    rows = t.match_panel(spark, sf).select("player_id", "event", "fdr", "is_home", form)
    out = features.interaction_columns(rows)
    return t.rounded(out, ["pts_x_fdr", "home_x_form"]).select(
        "player_id", "event", "pts_x_fdr", "home_x_form"
    )


@query(
    "momentum_norm",
    "SC11 JOI7 AGG5",
    sql_with(t.SQL_MOMENTUM) + f"SELECT player_id AS id, {s6('momentum')} AS transfer_momentum_norm FROM momentum",
)
def momentum_norm(spark, sf):
    return t.rounded(features.momentum(t.entities(spark, sf)), ["transfer_momentum_norm"])


@query(
    "period_from_name",
    "SC16",
    """SELECT o_orderkey, CAST(o_orderkey % 40 AS INTEGER) AS period FROM orders""",
)
def period_from_name(spark, sf):
    name = F.concat(F.lit("best_gw"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".csv"))
    return t.table(spark, sf, "orders").select("o_orderkey", text.period_from_name(name).alias("period"))


@query(
    "latest_named",
    "SRC7 SC16",
    "SELECT 'best_gw' || max(n_nationkey) || '.csv' AS name, max(n_nationkey) AS period FROM nation",
)
def latest_named(spark, sf):
    from panelwright.sources.feeds import latest_named as newest

    name = F.concat(F.lit("best_gw"), F.col("n_nationkey").cast("string"), F.lit(".csv"))
    return newest(t.table(spark, sf, "nation").select(name.alias("name")), "name")


@query(
    "format_line",
    "SC17",
    """SELECT p_partkey, printf('  %-20s Price: £%s  PredPts: %s  FDR: %s  Home: %s  Value: %s', p_name,
      p_size::VARCHAR, p_brand, p_type, p_size::VARCHAR, p_partkey::VARCHAR) AS line FROM part""",
)
def format_line(spark, sf):
    line = text.format_line("p_name", "p_size", "p_brand", "p_type", "p_size", "p_partkey")
    return t.table(spark, sf, "part").select("p_partkey", line.alias("line"))
