"""Writers (SNK*). Any Hadoop URI works as a path, object stores included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.sources import manifest


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header (SNK1)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet, optionally partitioned (SNK2).

    Rows of one partition value may sit in many tasks; that costs files, not memory, and keeps a
    value with a third of all rows from landing in one task.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_json(df: DataFrame, path: str, keep_nulls: bool = False) -> str:
    """JSON lines (SNK3)."""
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)
    return path


def write_by_period(df: DataFrame, path: str, period: str) -> str:
    """Parquet partitioned by period, and then a manifest of its periods beside it (see feeds.read_newest)."""
    spark = df.sparkSession
    write_parquet(df, path, [period])
    log = f"{path}.manifest"
    present = spark.read.schema(df.schema).parquet(path).select(F.col(period).cast("bigint").alias("period")).distinct()
    manifest.append(present, log, manifest.next_seq(spark, log, manifest.TABLES))
    return path


def export_all(
    tables: Mapping[str, DataFrame],
    base_uri: str,
    period: int,
    fmt: str | Mapping[str, str] = "csv",
    versioned: bool = False,
) -> dict[str, str]:
    """Write every table below base_uri/<name>/gw=<period>, and then one manifest entry for each (SNK4).

    Re-running a period replaces that period only; other periods stay. versioned=True writes each run to a
    folder of its own instead, so that readers of the manifest never see a period half replaced.
    """
    writers = {"csv": write_csv, "parquet": write_parquet, "json": write_json}
    base, out, rows = base_uri.rstrip("/"), {}, []
    log, seq = manifest.exports(base), None
    for name, table in tables.items():
        spark = table.sparkSession
        seq = manifest.next_seq(spark, log, manifest.EXPORTS) if seq is None else seq
        kind = fmt if isinstance(fmt, str) else fmt.get(name, "csv")
        folder = f"{base}/versions/{seq}/{name}" if versioned else f"{base}/{name}"
        out[name] = writers[kind](table, f"{folder}/gw={int(period)}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        rows.append((name, int(period), kind, out[name], columns))
    if rows:
        schema = manifest.EXPORTS.removesuffix(", seq bigint")
        manifest.append(SparkSession.active().createDataFrame(rows, schema), log, seq)
    return out


def training_summary(counts: DataFrame, maes: DataFrame, periods: DataFrame, group: str) -> DataFrame:
    """Split, row counts, shares and errors as (metric, grp, value) rows (SNK5).

    counts: one row n_train, n_val, train_pct, val_pct; maes: one row per group with mae;
    periods: one row first_period, last_period, n_periods, n_train_periods, n_val_periods.
    """
    total = F.lit("all")

    def melt(df: DataFrame, names: Sequence[str]) -> DataFrame:
        pairs = [
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
        ]
        return df.select(F.inline(F.array(*pairs))).select("metric", total.alias("grp"), "value")

    per_group = maes.select(
        F.lit("mae").alias("metric"), F.col(group).cast("string").alias("grp"), F.col("mae").alias("value")
    )
    overall = maes.agg(F.avg("mae").alias("macro_mae"))
    return (
        melt(periods, ["first_period", "last_period", "n_periods", "n_train_periods", "n_val_periods"])
        .unionByName(melt(counts, ["n_train", "n_val", "train_pct", "val_pct"]))
        .unionByName(per_group)
        .unionByName(melt(overall, ["macro_mae"]))
    )
