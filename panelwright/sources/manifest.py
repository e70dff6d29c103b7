"""Append-only logs of what has been written whole: export manifests and refresh marks (SRC7, SNK4, STR1).

A log is a folder of JSON lines that is only ever added to. An entry is appended after the data it tells of,
by a write that shows up whole or not at all; the newest entry holds. So a job that dies in between leaves the
entry before in force, and readers find the newest period without looking at the others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

EXPORTS = "name string, period bigint, format string, path string, columns string, seq bigint"
TABLES = "period bigint, seq bigint"


def entries(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All whole entries of a log, none if there is no log; a line that can't be read is no entry."""
    try:
        return spark.read.schema(schema).json(log).filter(F.col("seq").isNotNull())
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append(rows: DataFrame, log: str, seq: int) -> None:
    """Add rows to a log under one sequence number."""
    rows.withColumn("seq", F.lit(int(seq)).cast("bigint")).coalesce(1).write.mode("append").json(log)


def next_seq(spark: SparkSession, log: str, schema: str) -> int:
    last = entries(spark, log, schema).agg(F.max("seq")).first()[0]
    return 0 if last is None else last + 1


def exports(base_uri: str) -> str:
    """The manifest of the exports below a folder."""
    return f"{base_uri.rstrip('/')}/manifest"


def newest_export(spark: SparkSession, base_uri: str, name: str, period: int | None = None) -> tuple[int, str, str, str] | None:
    """Period, format, path and columns of the newest (or the given) period's last export of a table."""
    rows = entries(spark, exports(base_uri), EXPORTS).filter(F.col("name") == name)
    if period is not None:
        rows = rows.filter(F.col("period") == int(period))
    found = rows.agg(F.max(F.struct("period", "seq", "format", "path", "columns")).alias("e")).first()[0]
    return None if found is None else (found.period, found.format, found.path, found.columns)


def read_export(spark: SparkSession, base_uri: str, name: str, period: int | None = None, column: str = "gw") -> DataFrame | None:
    """The newest (or the given) exported period of a table, read from its folder alone; None if there is none."""
    found = newest_export(spark, base_uri, name, period)
    if found is None:
        return None
    number, fmt, path, columns = found
    rows = spark.read.schema(columns).format(fmt)
    if fmt == "csv":
        rows = rows.option("header", True).option("escape", '"')
    return rows.load(path).withColumn(column, F.lit(number).cast("int"))
