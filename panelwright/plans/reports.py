"""Jobs on the exported predictions: the outlier report and the chat prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright import fixed_values as fixed
from panelwright.operators import messages, outliers
from panelwright.sources import feeds, manifest, schemas


def read_predictions(spark: SparkSession, base_uri: str, period: int | None = None) -> DataFrame:
    """The exported predictions of the newest (or the given) period.

    The manifest names the folder; exports without one are searched for the newest period.
    """
    exported = manifest.read_export(spark, base_uri, "predictions", period)
    if exported is not None:
        return exported
    rows = feeds.read_csv(spark, f"{base_uri}/predictions", _with_period(schemas.PREDICTIONS))
    return feeds.latest_partition(rows, "gw", period)


def read_best(spark: SparkSession, base_uri: str) -> DataFrame:
    """The exported ranked reports of all periods."""
    return feeds.read_csv(spark, f"{base_uri}/best_by_position", _with_period(schemas.RANKED_PREDICTIONS))


def _with_period(schema):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([*schema.fields, StructField("gw", IntegerType())])


def outlier_report(
    predictions: DataFrame,
    limits: Mapping[str, int] = fixed.OUTLIER_TOP,
    tie: Sequence[str] = ("Player", "Price(£m)"),
) -> DataFrame:
    """All positions at once: residuals, outlier flag, quadrant and relative scales."""
    x, y = "Price(£m)", "PredPts"
    shown = outliers.outlier_candidates(
        predictions, "Pos", x, y, limits, tie, ["RawPts", "AvgPts(L5)", "Sel%"]
    )
    out = outliers.regression_residuals(shown, "Pos", x, y)
    out = outliers.flag_outliers(out, "Pos", y, bounded=True)  # the limits cut each group to a few rows
    out = outliers.quadrant(out, "Pos", x, y, bounded=True)
    return outliers.relative_scales(out, "Pos", "AvgPts(L5)", "Sel%")


def prompts(
    updates: DataFrame,
    pairs: DataFrame,
    resets: DataFrame,
    best: DataFrame,
    body: str = "body",
    order: str = "update_id",
    **request,
) -> DataFrame:
    """Requests for the messages that get an answer, from raw updates and the stored exchanges.

    pairs: (chat_id, seq, question, answer); resets: (chat_id, seq). Stored rows come before all
    updates; updates follow each other by `order`, so a reset among them ends the history of later ones.
    """
    routed = messages.route_messages(updates, body).withColumn("__at", _at(1, order))
    stored, marks = (df.withColumn("__at", _at(0, "seq")) for df in (pairs, resets))
    marks = marks.select("chat_id", "__at").unionByName(routed.filter("route = 'reset'").select("chat_id", "__at"))
    questions = routed.filter("route = 'answer'").drop("route")
    context = messages.context_text(best)
    return messages.build_prompts(questions, stored, marks, context, order="__at", **request).drop("__at")


def _at(batch: int, order: str):
    return F.struct(F.lit(batch).alias("batch"), F.col(order).cast("long").alias("place"))
