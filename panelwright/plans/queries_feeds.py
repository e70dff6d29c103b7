"""Registered queries: feeds written by Spark from the given tables and read back, exports, refresh.

Documents hold a bounded number of rows (CHUNK), so no document grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from panelwright.operators import clean
from panelwright.plans import tables as t
from panelwright.plans.registry import query
from panelwright.session import scratch_path
from panelwright.sources import feeds, manifest, schemas, sinks
from panelwright.streaming import refresh

CHUNK = 500


def _documents(df, key: str, **arrays):
    """JSON documents of at most CHUNK rows each: key chunk -> one array field per argument."""
    chunk = F.expr(f"{key} div {CHUNK}").alias("chunk")
    lists = [F.collect_list(F.struct(*cols)).alias(name) for name, cols in arrays.items()]
    return df.groupBy(chunk).agg(*lists).drop("chunk")


@query(
    "json_array_scan",
    "SRC1",
    """SELECT c_custkey::BIGINT AS id, c_name AS web_name, c_nationkey::BIGINT AS team FROM customer""",
)
def json_array_scan(spark, sf):
    customer = t.table(spark, sf, "customer")
    element = [F.col("c_custkey").alias("id"), F.col("c_name").alias("web_name"), F.col("c_nationkey").alias("team")]
    events = [F.col("c_custkey").alias("id"), F.lit(True).alias("finished")]
    path = scratch_path(spark, "bootstrap")
    sinks.write_json(_documents(customer, "c_custkey", elements=element, events=events), path)
    return feeds.read_json_array(spark, path, "elements", schemas.PLAYER_CODES, multi_line=False)


@query(
    "json_records_scan",
    "SRC2 SNK3",
    t.sql_with(t.SQL_MATCHES)
    + """SELECT fixture_id::BIGINT AS id, event, finished::VARCHAR AS finished, team_h::BIGINT AS team_h, team_a::BIGINT AS team_a, team_h_difficulty,
      team_a_difficulty, team_h_score, team_a_score FROM matches""",
)
def json_records_scan(spark, sf):
    matches = t.matches(spark, sf).withColumnRenamed("fixture_id", "id")
    records = F.to_json(F.collect_list(F.struct(*matches.columns)))
    lines = matches.groupBy(F.expr(f"id div {CHUNK}").alias("chunk")).agg(records.alias("value"))
    path = scratch_path(spark, "fixtures")
    lines.select("value").write.text(path)
    out = feeds.read_json_records(spark, path, schemas.FIXTURES, multi_line=False)
    return out.drop("kickoff_time")


@query(
    "entity_history_scan",
    "SRC3",
    """SELECT c_nationkey::BIGINT AS player_id, c_custkey::BIGINT AS fixture, (c_custkey % 38)::INTEGER AS round,
      c_acctbal::VARCHAR AS total_points FROM customer""",
)
def entity_history_scan(spark, sf):
    """One payload folder per nation, the nation only in the path."""
    customer = t.table(spark, sf, "customer")
    row = F.struct(
        F.col("c_custkey").alias("fixture"),
        (F.col("c_custkey") % 38).cast("int").alias("round"),
        F.col("c_acctbal").cast("string").alias("total_points"),
    )
    chunk = F.expr(f"c_custkey div {CHUNK}").alias("chunk")
    payloads = customer.groupBy("c_nationkey", chunk).agg(F.collect_list(row).alias("history"))
    path = scratch_path(spark, "history")
    payloads.drop("chunk").write.partitionBy("c_nationkey").json(path)
    out = feeds.read_entity_history(
        spark, path, schemas.HISTORY, id_pattern=r"c_nationkey=(\d+)/", multi_line=False
    )
    return out.select("player_id", "fixture", "round", "total_points")


@query(
    "parquet_history_scan",
    "SRC4 SNK2",
    t.sql_with(t.SQL_FACTS) + "SELECT player_id, event, total_points, minutes FROM facts",
)
def parquet_history_scan(spark, sf):
    path = scratch_path(spark, "facts")
    facts = t.facts(spark, sf).select("player_id", "total_points", "minutes", "event")
    sinks.write_parquet(facts, path, ["event"])
    return feeds.read_history(spark, path, facts.schema).select(
        "player_id", "event", "total_points", "minutes"
    )


@query(
    "csv_roundtrip",
    "SRC5 SNK1",
    t.sql_with(t.SQL_PRODUCTS)
    + """SELECT id, 'say "hi", ' || "Player" AS "Player", "Pos", price AS "Price(£m)", pts AS "PredPts", form AS "AvgPts(L5)" FROM products""",
)
def csv_roundtrip(spark, sf):
    headers = {"price": "Price(£m)", "pts": "PredPts", "form": "AvgPts(L5)"}
    report = clean.rename_map(t.products(spark, sf).drop("share"), headers)
    report = report.withColumn("Player", F.concat(F.lit('say "hi", '), "Player"))
    path = sinks.write_csv(report, scratch_path(spark, "predictions"))
    return feeds.read_csv(spark, path, report.schema)


@query(
    "codes_scan",
    "SRC6 SNK1",
    "SELECT c_custkey::BIGINT AS id, c_name AS web_name, c_nationkey::BIGINT AS team FROM customer",
)
def codes_scan(spark, sf):
    codes = t.table(spark, sf, "customer").selectExpr("c_custkey id", "c_name web_name", "c_nationkey team")
    path = sinks.write_csv(codes, scratch_path(spark, "codes"))
    return feeds.read_csv(spark, path, schemas.PLAYER_CODES)


@query(
    "latest_partition",
    "SRC7 SNK2 AGG5",
    """SELECT o_orderkey, o_totalprice, (year(o_orderdate) - 1990)::INTEGER AS gw FROM orders
    WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""",
)
def latest_partition(spark, sf):
    """Periods 5 to 11: 9 is the newest by text, 11 by number."""
    orders = t.table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", (F.year("o_orderdate") - 1990).alias("gw")
    )
    path = sinks.write_by_period(orders, scratch_path(spark, "by-period"), "gw")
    return feeds.read_newest(spark, path, orders.schema, "gw")


@query(
    "json_sink_roundtrip",
    "SNK3",
    "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
)
def json_sink_roundtrip(spark, sf):
    supplier = t.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = sinks.write_json(supplier, scratch_path(spark, "suppliers"))
    return spark.read.schema(supplier.schema).json(path)


@query(
    "partitioned_export",
    "SNK4 SRC7",
    """SELECT 'customer' AS name, c_custkey AS id, c_acctbal AS amount, 12 AS gw FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, 12 FROM supplier
    UNION ALL SELECT 'part', p_partkey, p_retailprice, 12 FROM part""",
)
def partitioned_export(spark, sf):
    """Three tables exported for periods 9 and 12 in three formats; the newest read back."""
    tables = {
        "customer": t.table(spark, sf, "customer").selectExpr("c_custkey id", "c_acctbal amount"),
        "supplier": t.table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_acctbal amount"),
        "part": t.table(spark, sf, "part").selectExpr("p_partkey id", "p_retailprice amount"),
    }
    formats = {"customer": "csv", "supplier": "json", "part": "parquet"}
    base = scratch_path(spark, "export")
    for period in (9, 12):
        sinks.export_all(tables, base, period, formats)
    out = None
    for name in formats:
        newest = manifest.read_export(spark, base, name).select(F.lit(name).alias("name"), "id", "amount", "gw")
        out = newest if out is None else out.unionByName(newest)
    return out


@query(
    "incremental_refresh",
    "STR1",
    f"""SELECT event_id, user_id AS player_id, {t.SQL_DAY} AS event, value, true AS first_run, false AS second_run
    FROM events""",
)
def incremental_refresh(spark, sf):
    """Events streamed into a table by period; a second run without a newer period does nothing."""
    base = scratch_path(spark, "refresh")
    finished = t.periods(spark, sf).withColumn("finished", F.lit("True"))
    schema = T.StructType.fromDDL(t.SCHEMAS["events"])
    files = t.table(spark, sf, "events").inputFiles()
    single = len(files) == 1 and files[0].endswith("/events.parquet")

    def prepare(stream):
        return stream.select(
            "event_id", F.col("user_id").alias("player_id"), t.day("ts").alias("event"), "value"
        )

    settings = dict(
        # the table may be a file or a folder of part files; a stream reads folders
        landing=sf if single else f"{sf}/events.parquet",
        pattern="events.parquet" if single else "*.parquet",
        schema=schema,
        table=f"{base}/table",
        checkpoint=f"{base}/checkpoint",
        prepare=prepare,
    )
    first = refresh.incremental_refresh(spark, finished, f"{base}/mark", **settings)
    second = refresh.incremental_refresh(spark, finished, f"{base}/mark", **settings)
    rows = refresh.read_refreshed(spark, f"{base}/table")
    return rows.select(
        "event_id", "player_id", "event", "value", F.lit(first).alias("first_run"), F.lit(second).alias("second_run")
    )
