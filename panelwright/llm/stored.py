"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.session import remove, scratch_path

# Shuffle files of the job go as soon as it has ended. A compressed table's file size says little about
# its size in memory, so Spark isn't left to broadcast by it; broadcasts that are asked for still happen.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",  # whole texts are long
    "parquet.block.size": str(16 << 20),  # a writer holds a row group of texts, a reader the columns of one
}
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
GROUP_BYTES = "parquet.block.size"


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python and to files in batches as small as stored() does, also in the caller's own write.

    Sets the session's rows per Arrow batch and bytes per row group, unless it asks for fewer already; results don't
    depend on them.
    """
    if int(spark.conf.get(BATCH_ROWS)) > int(SETTINGS[BATCH_ROWS]):
        spark.conf.set(BATCH_ROWS, SETTINGS[BATCH_ROWS])
    if int(spark.conf.get(GROUP_BYTES, str(128 << 20))) > int(SETTINGS[GROUP_BYTES]):
        spark.conf.set(GROUP_BYTES, SETTINGS[GROUP_BYTES])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends, lost executors don't matter."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def free(*frames: DataFrame) -> None:
    """Remove stored tables that nothing will read again: what was made of them is written already."""
    for df in frames:
        remove(df.sparkSession, df.stored_path)
