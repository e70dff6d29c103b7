"""The driver tables in panel roles, on the Spark side and as SQL for the oracle.

player = customer, period = day of an event, team = nation, group = market segment. Matches are
orders; the columns derived here are listed in FIXTURES.md section C.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.functions.scalars import lookup, round_half_even
from panelwright.operators.context import match_context
from panelwright.operators.joins import attach, missing_keys, restrict_to
from panelwright.operators.panel import complete_panel, unpivot_sides

STATS = [
    "total_points", "minutes", "goals_scored", "assists", "clean_sheets", "goals_conceded", "saves",
    "expected_goal_involvements",
]
CONTEXT = ["score_for", "score_ag", "fdr", "is_home"]
# Segment to group code, as the entity dimension carries codes.
SEGMENTS = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}
LABELS = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}


# Stated schemas: no footer is read to plan a query.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    "l_shipdate timestamp_ntz",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> Column:
    """Six digits and no negative zero: float noise must not show in a comparison."""
    c = F.col(c) if isinstance(c, str) else c
    rounded = F.round(c, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: r6(f"`{c}`") for c in columns})


def day(c: str) -> Column:
    return F.unix_date(F.to_date(c))


def facts(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """One row per player and day; combined per task before the shuffle, so hot users are fine.

    ids: the players wanted; events of others are dropped before anything is added up.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("player_id"), day("ts").alias("event"), "event_type", "value"
    )
    events = events if ids is None else restrict_to(events, ids, "player_id")

    def count_of(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind).cast("double")

    return events.groupBy("player_id", "event").agg(
        F.round(F.sum("value"), 2).alias("total_points"),
        (F.count("*") * 15).cast("double").alias("minutes"),
        count_of("purchase").alias("goals_scored"),
        count_of("click").alias("assists"),
        count_of("signup").alias("clean_sheets"),
        count_of("error").alias("goals_conceded"),
        count_of("view").alias("saves"),
        (count_of("purchase") * 0.5 + count_of("click") * 0.25).alias("expected_goal_involvements"),
    )


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(day("ts").alias("event")).distinct()


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players: group code, team, price in tenths, status, chance."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("player_id"),
        F.col("c_name").alias("web_name"),
        lookup("c_mktsegment", SEGMENTS).alias("element_type"),
        F.col("c_nationkey").alias("team"),
        F.floor(F.abs("c_acctbal") / 100).cast("int").alias("now_cost"),
        F.when(key % 7 == 0, "i").otherwise("a").alias("status"),
        F.when(key % 3 == 0, (25 * (key % 5)).cast("double")).alias("chance"),
    )


def panel(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Every customer (or those wanted) on every day with events; gaps are zero."""
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"))
    return complete_panel(every if ids is None else ids, periods(spark, sf_dir), facts(spark, sf_dir, ids), stats=STATS)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches by month."""
    orders = table(spark, sf_dir, "orders")
    home = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team_h")
    )
    key = F.col("o_orderkey")
    joined = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(
        home, "o_custkey"
    )
    return joined.select(
        key.alias("fixture_id"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("event"),
        (F.col("o_orderstatus") == "F").alias("finished"),
        "team_h",
        ((key * 7 + 3) % 25).cast("int").alias("team_a"),
        (1 + key % 5).cast("int").alias("team_h_difficulty"),
        (1 + (key * 3) % 5).cast("int").alias("team_a_difficulty"),
        (key % 4).cast("int").alias("team_h_score"),
        (key % 3).cast("int").alias("team_a_score"),
    )


def calendar_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches dealt over the panel's days and the day after: month m of the calendar
    plays on first day + m mod (days + 1)."""
    days = periods(spark, sf_dir).agg(F.min("event").alias("lo"), F.max("event").alias("hi"))
    first = days.select("lo").scalar()
    span = days.select(F.col("hi") - F.col("lo") + 2).scalar()
    return matches(spark, sf_dir).withColumn("event", (first + F.col("event") % span).cast("int"))


def last_day(spark: SparkSession, sf_dir: str) -> Column:
    return periods(spark, sf_dir).agg(F.max("event")).scalar()


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match context per team and day of the panel; the day after has not been played."""
    played = calendar_matches(spark, sf_dir).filter(F.col("event") <= last_day(spark, sf_dir))
    return match_context(unpivot_sides(played, keep=["fixture_id"]))


def history(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Facts with the player's team and that team's match of the day."""
    team = players(spark, sf_dir).select("player_id", "team")
    out = attach(facts(spark, sf_dir, ids), team, "player_id")
    fills = {"fdr": 3.0, "is_home": 0.0, "score_for": 0.0, "score_ag": 0.0}
    return attach(out, context(spark, sf_dir), ["team", "event"], fills=fills)


def idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The players that have no facts: their rows in the panel are all alike."""
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id")).filter("player_id is not null")
    return missing_keys(every, table(spark, sf_dir, "events").select(F.col("user_id").alias("player_id")), "player_id")


def active_panel(spark: SparkSession, sf_dir: str, also: int | None = None) -> DataFrame:
    """The panel, with match context, of the players that have facts: all that a filter on activity can leave.

    also: the id of one more player.
    """
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"))
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("player_id"))
    active = restrict_to(every, known, "player_id")
    return complete_panel(
        active if also is None else active.unionByName(every.filter(F.col("player_id") == also)),
        periods(spark, sf_dir),
        history(spark, sf_dir),
        stats=STATS + CONTEXT,
        fills={"fdr": 3.0},
    )


def match_panel(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The panel, of the players wanted, with match context."""
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"))
    return complete_panel(
        every if ids is None else ids,
        periods(spark, sf_dir),
        history(spark, sf_dir, ids),
        stats=STATS + CONTEXT,
        fills={"fdr": 3.0},
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players under the names the forecast reads, with transfer counts from their events."""
    moves = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("id"))
        .agg(
            F.count_if(F.col("event_type") == "purchase").alias("transfers_in_event"),
            F.count_if(F.col("event_type") == "error").alias("transfers_out_event"),
        )
    )
    base = players(spark, sf_dir).withColumnsRenamed(
        {"player_id": "id", "chance": "chance_of_playing_next_round"}
    )
    return attach(base, moves, "id")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as long chats: five threads follow each other in one chat."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.expr("conv_id div 5").alias("chat_id"),
        (F.col("conv_id") % 5 * 1_000_000 + F.col("turn")).alias("seq"),
        "conv_id",
        "turn",
        "role",
        "text",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as predictions: price = size, points = retail price, with a few gaps."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("Player"),
        F.col("p_type").alias("Pos"),
        F.col("p_size").cast("double").alias("price"),
        round_half_even(F.col("p_retailprice") / 100 + key % 7, 2).alias("pts"),
        F.when(key % 11 != 0, (key % 150) / F.lit(10.0)).alias("form"),
        F.when(key % 13 != 0, (key % 89) / F.lit(2.0)).alias("share"),
    )


# --- the same tables as SQL -------------------------------------------------


def s6(expr: str) -> str:
    """SQL twin of r6."""
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END)"


def rint(expr: str, digits: int) -> str:
    """SQL twin of round_half_even."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"(round_even(({expr}) * {scale}, 0)::DOUBLE / {scale})"


SQL_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER)"
SQL_CODE = "CASE c_mktsegment " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in SEGMENTS.items()
) + " END"
SQL_FACTS = f"""
facts AS (
  SELECT user_id AS player_id, {SQL_DAY} AS event,
    round(sum(value), 2) AS total_points,
    CAST(count(*) * 15 AS DOUBLE) AS minutes,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS goals_scored,
    CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS assists,
    CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) AS clean_sheets,
    CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS goals_conceded,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS saves,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') * 0.5
      + count(*) FILTER (WHERE event_type = 'click') * 0.25 AS DOUBLE) AS expected_goal_involvements
  FROM events GROUP BY 1, 2),
periods AS (SELECT DISTINCT {SQL_DAY} AS event FROM events)"""
SQL_PANEL = (
    SQL_FACTS
    + """,
panel AS (
  SELECT c.c_custkey AS player_id, p.event, """
    + ", ".join(f"coalesce(f.{s}, 0.0::DOUBLE) AS {s}" for s in STATS)
    + """
  FROM customer c CROSS JOIN periods p
  LEFT JOIN facts f ON f.player_id = c.c_custkey AND f.event = p.event)"""
)
SQL_PLAYERS = f"""
players AS (
  SELECT c_custkey AS player_id, c_name AS web_name, {SQL_CODE} AS element_type,
    c_nationkey AS team, CAST(floor(abs(c_acctbal) / 100) AS INTEGER) AS now_cost,
    CASE WHEN c_custkey % 7 = 0 THEN 'i' ELSE 'a' END AS status,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(25 * (c_custkey % 5) AS DOUBLE) END AS chance
  FROM customer)"""
SQL_MATCHES = """
matches AS (
  SELECT o_orderkey AS fixture_id,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS event,
    (o_orderstatus = 'F') AS finished, c_nationkey AS team_h,
    CAST((o_orderkey * 7 + 3) % 25 AS INTEGER) AS team_a,
    CAST(1 + o_orderkey % 5 AS INTEGER) AS team_h_difficulty,
    CAST(1 + (o_orderkey * 3) % 5 AS INTEGER) AS team_a_difficulty,
    CAST(o_orderkey % 4 AS INTEGER) AS team_h_score,
    CAST(o_orderkey % 3 AS INTEGER) AS team_a_score
  FROM orders JOIN customer ON c_custkey = o_custkey)"""
SQL_CALENDAR_MATCHES = (
    SQL_MATCHES
    + f""",
span AS (SELECT min({SQL_DAY}) AS lo, max({SQL_DAY}) AS hi FROM events),
calendar AS (
  SELECT m.* REPLACE (CAST(lo + m.event % (hi - lo + 2) AS INTEGER) AS event)
  FROM matches m, span)"""
)


def sql_sides(source: str, defaults: bool = True) -> str:
    """CTE `sides` of a match table."""

    def pick(column: str, default: int) -> str:
        c = f"CAST({column} AS DOUBLE)"
        return f"coalesce(nullif({c}, 0), {default}.0::DOUBLE)" if defaults else c

    def side(own: str, other: str, home: str) -> str:
        return f"""SELECT event, fixture_id, finished, team_{own} AS team, team_{other} AS opponent,
    {pick(f"team_{own}_difficulty", 3)} AS fdr, {home}::DOUBLE AS is_home,
    {pick(f"team_{own}_score", 0)} AS score_for, {pick(f"team_{other}_score", 0)} AS score_ag
  FROM {source}"""

    return f"sides AS ({side('h', 'a', '1.0')} UNION ALL {side('a', 'h', '0.0')})"


SQL_CONTEXT = (
    SQL_CALENDAR_MATCHES
    + ", "
    + sql_sides("(SELECT c.* FROM calendar c, span WHERE c.event <= span.hi)")
    + """,
context AS (
  SELECT team, event, fdr, is_home, score_for, score_ag FROM sides
  QUALIFY row_number() OVER (PARTITION BY team, event ORDER BY fixture_id, is_home) = 1)"""
)
# needs SQL_FACTS, SQL_PLAYERS and SQL_CONTEXT before it
SQL_MATCH_PANEL = (
    """
history AS (
  SELECT f.*, p.team, coalesce(c.fdr, 3.0::DOUBLE) AS fdr, coalesce(c.is_home, 0.0::DOUBLE) AS is_home,
    coalesce(c.score_for, 0.0::DOUBLE) AS score_for, coalesce(c.score_ag, 0.0::DOUBLE) AS score_ag
  FROM facts f LEFT JOIN players p USING (player_id) LEFT JOIN context c USING (team, event)),
match_panel AS (
  SELECT c.c_custkey AS player_id, p.event, coalesce(h.fdr, 3.0::DOUBLE) AS fdr, """
    + ", ".join(f"coalesce(h.{s}, 0.0::DOUBLE) AS {s}" for s in STATS + CONTEXT if s != "fdr")
    + """
  FROM customer c CROSS JOIN periods p
  LEFT JOIN history h ON h.player_id = c.c_custkey AND h.event = p.event)"""
)
SQL_MOMENTUM = """
moves AS (
  SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'purchase')
    - count(*) FILTER (WHERE event_type = 'error') AS net
  FROM events GROUP BY 1),
momentum AS (
  SELECT c_custkey AS player_id, CASE WHEN (SELECT max(abs(net)) FROM moves) > 0
    THEN coalesce(net, 0)::DOUBLE / (SELECT max(abs(net)) FROM moves) ELSE 0.0::DOUBLE END AS momentum
  FROM customer LEFT JOIN moves ON id = c_custkey)"""
SQL_TURNS = """
turns AS (
  SELECT conv_id // 5 AS chat_id, conv_id % 5 * 1000000 + turn AS seq, conv_id, turn, role, text
  FROM conversations)"""
SQL_PRODUCTS = f"""
products AS (
  SELECT p_partkey AS id, p_name AS "Player", p_type AS "Pos", CAST(p_size AS DOUBLE) AS price,
    {rint("p_retailprice / 100 + p_partkey % 7", 2)} AS pts,
    CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 150) / 10.0::DOUBLE END AS form,
    CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 89) / 2.0::DOUBLE END AS share
  FROM part)"""


def sql_with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes)
