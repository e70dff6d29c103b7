"""Registered queries: outliers, quadrants, scales, report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import windows
from panelwright.operators import aggregates, messages, outliers, ranking
from panelwright.plans import tables as t
from panelwright.plans.registry import query
from panelwright.plans.tables import s6, sql_with

LIMITS = {"ECONOMY": 20, "SMALL": 50, "MEDIUM": 60, "LARGE": 30, "PROMO": 40}
SQL_LIMIT = 'CASE "Pos" ' + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items()) + " END"
SQL_CANDIDATES = f"""
cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY "Pos" ORDER BY pts DESC, id) AS INTEGER) AS "Rank"
  FROM products WHERE price IS NOT NULL AND pts > 0 QUALIFY "Rank" <= {SQL_LIMIT})"""
SQL_WHOLE = 'cand AS (SELECT *, 0 AS "Rank" FROM products WHERE price IS NOT NULL AND pts > 0)'
SQL_OUTLIERS = f"""
line AS (SELECT "Pos", regr_slope(pts, price) AS slope, regr_intercept(pts, price) AS intercept,
  quantile_cont(pts, 0.88) AS y_top FROM cand GROUP BY 1),
res AS (SELECT c.*, slope, intercept, y_top, pts - (intercept + slope * price) AS resid
  FROM cand c JOIN line USING ("Pos")),
flagged AS (SELECT *, abs(resid) > 0.9 * (stddev_pop(resid) OVER (PARTITION BY "Pos")) OR pts >= round(y_top, 9)
  AS is_outlier FROM res)
SELECT id, "Pos", {s6("slope")} AS slope, {s6("resid")} AS resid, is_outlier FROM flagged"""


def _candidates(spark, sf, limits):
    return outliers.outlier_candidates(
        t.products(spark, sf), "Pos", "price", "pts", limits, ["id"], ["form", "share"]
    )


def _flagged(df, bounded):
    out = outliers.regression_residuals(df, "Pos", "price", "pts")
    out = outliers.flag_outliers(out, "Pos", "pts", bounded=bounded)
    return t.rounded(out, ["slope", "resid"]).select("id", "Pos", "slope", "resid", "is_outlier")


@query(
    "outlier_candidates",
    "OUT1 SC1 FLT5 FLT8 SRT4",
    sql_with(t.SQL_PRODUCTS, SQL_CANDIDATES) + 'SELECT id, "Pos", price, pts, "Rank" FROM cand',
)
def outlier_candidates(spark, sf):
    return _candidates(spark, sf, LIMITS).select("id", "Pos", "price", "pts", "Rank")


@query(
    "ols_outliers",
    "OUT1 OUT2 OUT3 AGG10 FLT8 FLT11",
    sql_with(t.SQL_PRODUCTS, SQL_CANDIDATES, SQL_OUTLIERS.strip()),
)
def ols_outliers(spark, sf):
    return _flagged(_candidates(spark, sf, LIMITS), bounded=True)


@query(
    "ols_outliers_whole",
    "OUT2 OUT3 AGG10 FLT11",
    sql_with(t.SQL_PRODUCTS, SQL_WHOLE, SQL_OUTLIERS.strip()),
)
def ols_outliers_whole(spark, sf):
    return _flagged(_candidates(spark, sf, None), bounded=False)


SQL_QUADRANT = """
mid AS (SELECT "Pos", median(price) AS x_mid, median(pts) AS y_mid FROM cand GROUP BY 1)
SELECT id, "Pos", CASE WHEN price < x_mid AND pts > round(y_mid, 9) THEN 'HIGH VALUE'
  WHEN price < x_mid THEN 'CHEAP & WEAK' WHEN pts > round(y_mid, 9) THEN 'PREMIUM'
  ELSE 'OVERPRICED' END AS quadrant FROM cand JOIN mid USING ("Pos")"""


@query("quadrants", "OUT4 AGG10", sql_with(t.SQL_PRODUCTS, SQL_CANDIDATES, SQL_QUADRANT.strip()))
def quadrants(spark, sf):
    out = outliers.quadrant(_candidates(spark, sf, LIMITS), "Pos", "price", "pts")
    return out.select("id", "Pos", "quadrant")


@query("quadrants_whole", "OUT4 AGG10", sql_with(t.SQL_PRODUCTS, SQL_WHOLE, SQL_QUADRANT.strip()))
def quadrants_whole(spark, sf):
    out = outliers.quadrant(_candidates(spark, sf, None), "Pos", "price", "pts", bounded=False)
    return out.select("id", "Pos", "quadrant")


@query(
    "relative_scales",
    "OUT5 SC12 SC13",
    sql_with(t.SQL_PRODUCTS, SQL_CANDIDATES, """
    v AS (SELECT *, least(greatest(coalesce(form, 2.0::DOUBLE), 0.5::DOUBLE), 12.0::DOUBLE) AS sz,
      coalesce(share, 5.0::DOUBLE) AS sh FROM cand)""")
    + f"""SELECT id, {s6('sz / max(sz) OVER (PARTITION BY "Pos")')} AS rel_size,
      {s6('(sh - min(sh) OVER g) / (max(sh) OVER g - min(sh) OVER g + 1e-9::DOUBLE)')} AS rel_share
    FROM v WINDOW g AS (PARTITION BY "Pos")""",
)
def relative_scales(spark, sf):
    out = outliers.relative_scales(_candidates(spark, sf, LIMITS), "Pos", "form", "share")
    return t.rounded(out, ["rel_size", "rel_share"]).select("id", "rel_size", "rel_share")


@query(
    "column_stats_top",
    "AGG10",
    sql_with(t.SQL_PRODUCTS, SQL_CANDIDATES)
    + f"""SELECT "Pos", count(pts) AS n, min(pts) AS min, max(pts) AS max, {s6("stddev_pop(pts)")} AS std,
      {s6("median(pts)")} AS median, {s6("quantile_cont(pts, 0.88)")} AS p FROM cand GROUP BY 1""",
)
def column_stats_top(spark, sf):
    stats = aggregates.column_stats(_candidates(spark, sf, LIMITS), "pts", ["Pos"], bounded=True)
    return t.rounded(stats, ["std", "median", "p"])


GROUPS = ["ECONOMY", "SMALL", "MEDIUM", "LARGE"]
SQL_LINE = "printf('  %-20s Price: £%s  PredPts: %s  FDR: %s  Home: %s  Value: %s', p_name, p_size::VARCHAR, p_brand, p_partkey::VARCHAR, p_type, p_size::VARCHAR)"
SQL_CONTEXT_TEXT = f"""
ranked AS (SELECT p_partkey % 3 + 9 AS gw, p_type AS "Pos", {SQL_LINE} AS line, row_number() OVER
    (PARTITION BY p_partkey % 3, p_type ORDER BY p_retailprice DESC, p_partkey) AS "Rank"
  FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE')),
lines AS (SELECT *, CASE "Pos" WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS place
  FROM ranked WHERE "Rank" <= 10 AND gw = 11),
context AS (SELECT CAST(gw AS INTEGER) AS gw, 'GW11 Predictions:' || chr(10) || string_agg(
  CASE WHEN "Rank" = 1 THEN chr(10) || "Pos" || ':' || chr(10) || line ELSE line END, chr(10)
  ORDER BY place, "Rank") AS text FROM lines GROUP BY 1)"""


def best_parts(spark, sf):
    """A ranked report of the parts over three periods: 9, 10 and 11."""
    part = t.table(spark, sf, "part").select(
        (F.col("p_partkey") % 3 + 9).cast("int").alias("gw"),
        F.col("p_type").alias("Pos"),
        F.col("p_name").alias("Player"),
        F.col("p_size").alias("Price(£m)"),
        F.col("p_brand").alias("PredPts"),
        F.col("p_partkey").alias("FDR"),
        F.col("p_type").alias("Home"),
        F.col("p_size").alias("Value"),
        "p_retailprice",
        "p_partkey",
    )
    keyed = part.withColumn("grp", F.concat_ws("/", "gw", "Pos"))
    return ranking.top_per_group(keyed, "grp", "p_retailprice", 10, ["p_partkey"])


@query(
    "group_start",
    "WIN10",
    """SELECT gw, p_partkey, coalesce("Pos" <> lag("Pos") OVER w, true) AS is_start FROM (
      SELECT CAST(p_partkey % 3 + 9 AS INTEGER) AS gw, p_type AS "Pos", p_partkey, row_number() OVER
        (PARTITION BY p_partkey % 3, p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    WHERE rank <= 10 WINDOW w AS (PARTITION BY gw ORDER BY rank, "Pos")""",
)
def group_start(spark, sf):
    """Group changes in a report of ten rows per group, read rank by rank."""
    start = windows.is_group_start("Pos", ["gw"], ["Rank", "Pos"])
    return best_parts(spark, sf).select("gw", "p_partkey", start.alias("is_start"))


@query(
    "context_text",
    "CHT4 WIN10 SC16 SC17 AGG11 SRC7",
    sql_with(SQL_CONTEXT_TEXT) + "SELECT * FROM context",
)
def context_text(spark, sf):
    return messages.context_text(best_parts(spark, sf), groups=GROUPS)
