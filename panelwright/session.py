"""Shared scratch space of a session: the folder named in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings the jobs are tuned for; set them when the session or cluster is created.
# Wide feature projections compile to methods HotSpot refuses to compile (over 8000 bytes); with
# this limit Spark runs those projections outside whole-stage code, which is far faster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_LOCAL_DIRS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}  # scratch paths by application, oldest first


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. Falls back to a temp folder only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="panelwright-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; removed when the session's Python process ends, or by a scope."""
    path = f"{shared_dir(spark)}/panelwright/{label}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(_end, spark, app)
    _MADE[app].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, wherever the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    made = _MADE.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables that were made inside once it is left, by an error too.

    For work whose results are collected or written before it ends; frames that are still to be read need theirs.
    """
    app = spark.sparkContext.applicationId
    before = set(_MADE.get(app, []))
    try:
        yield
    finally:
        for path in [p for p in _MADE.get(app, []) if p not in before]:
            remove(spark, path)


def _end(spark: SparkSession, app: str) -> None:
    context = spark.sparkContext
    if getattr(context, "_jsc", None) is None or context.applicationId != app:
        return  # the session was stopped before: its folder outlives it
    for path in list(_MADE.get(app, [])):
        remove(spark, path)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() and ML checkpointInterval usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialise(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut lineage: write the frame to the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the table outlives lost executors. Readers that
    want one value of a partition column scan that folder only.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
