"""Incremental refresh of the history behind a high-water mark (STR1)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from panelwright.operators.panel import first_per_key
from panelwright.sources import manifest
from panelwright.sources.feeds import finished_periods

BATCH = "batch_id"


MARKS = "last_finished_gw int, newest_landed bigint, batch bigint, seq bigint"


def _last_mark(spark: SparkSession, marker: str):
    return manifest.entries(spark, marker, MARKS).agg(F.max(F.struct("seq", "last_finished_gw", "newest_landed"))).first()[0]


def read_mark(spark: SparkSession, marker: str) -> int:
    """The newest finished period of the last whole mark, -1 when there is none yet."""
    last = _last_mark(spark, marker)
    return -1 if last is None or last.last_finished_gw is None else last.last_finished_gw


def write_mark(
    spark: SparkSession, marker: str, period: int, newest_landed: int | None = None, batch: int | None = None
) -> None:
    """Add a mark to the log; marks before it stay, so there is one at any time."""
    rows = spark.createDataFrame([(int(period), newest_landed, batch)], MARKS.removesuffix(", seq bigint"))
    manifest.append(rows, marker, manifest.next_seq(spark, marker, MARKS))


def newest_finished(fixtures: DataFrame, complete: bool = False) -> int:
    """Newest finished period of the feed, 0 when nothing has finished."""
    periods = finished_periods(fixtures, complete=complete)
    return periods.agg(F.coalesce(F.max("event"), F.lit(0))).first()[0]


def drain(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    table: str,
    checkpoint: str,
    period: str = "event",
    fmt: str = "parquet",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int | None = None,
    pattern: str | None = None,
) -> tuple[int | None, int | None]:
    """Move everything new in the landing folder into the table, then stop.

    Returns the newest period that came and the last batch, None for nothing.

    Each micro-batch owns the folders <period>/<batch id> it writes and replaces just those, so a
    batch that is run again after a failure leaves the same table.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    stream = reader.load(landing)
    stream = prepare(stream) if prepare else stream

    landed: list[tuple[int, int]] = []

    def land(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        (
            batch.withColumn(BATCH, F.lit(batch_id))
            .observe(seen, F.max(period).cast("bigint").alias("newest"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(period, BATCH)
            .parquet(table)
        )
        if (newest := seen.get["newest"]) is not None:
            landed.append((newest, batch_id))

    query = (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return max((n for n, _ in landed), default=None), max((b for _, b in landed), default=None)


def read_refreshed(
    spark: SparkSession, table: str, keys: Sequence[str] | None = None
) -> DataFrame:
    """The refreshed table; with keys, the newest landed version of each key."""
    rows = spark.read.parquet(table)
    if keys:
        rows = first_per_key(rows, keys, [F.col(BATCH).desc()])
    return rows.drop(BATCH)


def newest_present(spark: SparkSession, table: str, period: str) -> int | None:
    """The newest period that the refreshed table holds; None if nothing has landed yet."""
    try:
        return spark.read.parquet(table).agg(F.max(period)).first()[0]
    except AnalysisException:  # the first file makes the table
        return None


def incremental_refresh(
    spark: SparkSession,
    fixtures: DataFrame,
    marker: str,
    force: bool = False,
    complete: bool = False,
    **landing,
) -> bool:
    """Drain the landing zone when a newer period has finished; True when it did.

    The mark is written after the data, so a run that dies in between is repeated, not skipped. It never
    passes the newest period that has landed: files that come late are drained by a later run.
    """
    newest = newest_finished(fixtures, complete)
    last = _last_mark(spark, marker)
    if not force and newest == read_mark(spark, marker):
        return False
    came, batch = drain(spark, **landing)
    known = None if last is None else last.newest_landed
    if known is None or came is None:  # no mark yet, or what came was landed by a run that died before its mark
        present = newest_present(spark, landing["table"], landing.get("period", "event"))
    else:
        present = max(known, came)
    if present is None:
        return False
    write_mark(spark, marker, min(newest, present), present, batch)
    return True
