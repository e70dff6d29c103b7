"""Scans: JSON landing files, parquet history, CSV results and code lists (SRC*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelwright.functions.scalars import is_true
from panelwright.functions.text import period_from_name
from panelwright.sources import json_blocks, manifest


def read_json_array(
    spark: SparkSession, path: str, field: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """One array of nested JSON documents as a table (SRC1).

    A document may be of any size and is read by many tasks (see json_blocks). With multi_line=False every
    line is a document, and only the wanted array is in the read schema, so the parser skips the others.
    """
    if multi_line:
        return json_blocks.read_records(spark, path, schema, field)
    document = T.StructType([T.StructField(field, T.ArrayType(schema))])
    return spark.read.schema(document).json(path).select(F.inline(field))


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Top-level JSON arrays of records (SRC2), read by many tasks; multi_line=False for one array per line."""
    if multi_line:
        return json_blocks.read_records(spark, path, schema)
    return spark.read.schema(schema).json(path)


def read_entity_history(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    id_pattern: str = r"(\d+)\.json",
    id_column: str = "player_id",
    field: str = "history",
    multi_line: bool = True,
) -> DataFrame:
    """Landed per-entity payloads with the entity id taken from the path (SRC3).

    Unreadable payloads and payloads without rows contribute nothing.
    """
    document = T.StructType([T.StructField(field, T.ArrayType(schema))])
    rows = (
        spark.read.schema(document)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .json(path)
    )
    entity = F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).try_cast("bigint")
    return rows.select(entity.alias(id_column), F.col(field)).select(id_column, F.inline(field))


def read_history(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet history (SRC4); pass the schema to skip footer inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line: predictions (SRC5) and code lists (SRC6).

    Fields are written quoted where needed; quotes inside are doubled.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def latest_partition(df: DataFrame, column: str, value: int | None = None) -> DataFrame:
    """Rows of the given period, else of the numerically newest one (SRC7).

    On a table partitioned by the column both forms read only the matching folders: the newest
    value arrives as a scalar subquery.
    """
    if value is not None:
        return df.filter(F.col(column) == value)
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def read_newest(spark: SparkSession, path: str, schema: T.StructType, period: str) -> DataFrame:
    """The newest period of a table of sinks.write_by_period: its manifest says which, only that is read (SRC7)."""
    known = manifest.entries(spark, f"{path}.manifest", manifest.TABLES)
    last = known.agg(F.max("seq").alias("seq")).scalar()
    newest = known.filter(F.col("seq") == last).agg(F.max("period")).scalar()
    return spark.read.schema(schema).parquet(path).filter(F.col(period) == newest.cast(schema[period].dataType))


def latest_named(names: DataFrame, column: str, tag: str = "gw") -> DataFrame:
    """The file name with the largest period number in it; gw10 is newer than gw9."""
    period = period_from_name(column, tag)
    return names.select(F.max_by(F.col(column), period).alias(column), F.max(period).alias("period"))


def finished_periods(
    fixtures: DataFrame, period: str = "event", finished: str = "finished", complete: bool = False
) -> DataFrame:
    """Distinct periods with a finished match (SRC8); complete=True: with no unfinished one."""
    flag = is_true(finished)
    if not complete:
        return fixtures.filter(flag & F.col(period).isNotNull()).select(period).distinct()
    per_period = fixtures.filter(F.col(period).isNotNull()).groupBy(period)
    return per_period.agg(F.min(flag).alias("done")).filter("done").select(period)


def last_finished(periods: DataFrame, period: str = "event") -> Column:
    """Newest finished period as a scalar subquery, 0 when there is none."""
    return periods.agg(F.coalesce(F.max(period), F.lit(0))).scalar()
