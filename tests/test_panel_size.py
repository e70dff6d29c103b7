"""Tasks of a panel follow its rows, and a training set reads no panel of players without facts."""

import datetime

from pyspark.sql import functions as F

from panelwright.operators import clean, features, panel
from panelwright.plans import tables as t


def test_tasks_follow_the_rows_of_the_panel(spark, monkeypatch):
    monkeypatch.setattr(panel, "PANEL_ROWS", 500)
    ids = spark.range(1000).select(F.col("id").alias("player_id"))
    days = spark.range(30).select(F.col("id").cast("int").alias("event"))
    facts = spark.createDataFrame([(3, 4, 2.0), (3, 5, 1.0), (2000, 1, 9.0)], "player_id bigint, event int, minutes double")
    found = panel.complete_panel(ids.union(ids), days, facts)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) > 30 and max(sizes) <= 60 * 30
    assert found.rdd.getNumPartitions() == 60
    assert found.agg(F.sum("minutes")).first()[0] == 3.0
    few = panel.complete_panel(ids.limit(2), days, facts)
    assert few.count() == 60


def test_only_active_players_are_in_the_training_panel(spark, tmp_path):
    def at(day):
        return datetime.datetime(2024, 1, day)

    events = [(i, at(1 + i % 9), user, "view", 1.5, None) for i, user in enumerate([1, 1, 2, None, 99] * 9)]
    people = [(k, f"c{k}", k % 3, 10.0, "BUILDING" if k % 2 else None) for k in [*range(40), 1]]
    orders = [(i, i % 40, "F", 1.0, at(1 + i), "x") for i in range(20)]
    for name, rows in (("events", events), ("customer", people), ("orders", orders)):
        spark.createDataFrame(rows, t.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    active, whole = t.active_panel(spark, str(tmp_path)), t.match_panel(spark, str(tmp_path))
    assert active.count() == 2 * 9 and whole.count() == 40 * 9

    def learned(rows):
        rows = features.panel_features(rows, t.entities(spark, str(tmp_path)))
        return sorted(map(str, clean.active_only(rows, "minutes_mean5", 1).drop("momentum").collect()))

    assert learned(active) == learned(whole) != []
