"""A salted join deals the copies of its dimension; no task holds all of them."""

from pyspark.sql import functions as F

from panelwright.operators.joins import attach


def test_copies_are_not_broadcast(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v")).write.parquet(f"{tmp_path}/dim")
    dim = spark.read.parquet(f"{tmp_path}/dim")
    left = spark.range(400).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 60).alias("key"))
    out = attach(left, dim, {"key": "k"}, ["v"], salt=4, salt_by=["id"])
    rows = {r["id"]: (r["key"], r["v"]) for r in out.collect()}
    assert rows == {i: (None, None) if i % 7 == 0 else (i % 60, i % 60 % 3 if i % 60 < 50 else None) for i in range(400)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
