"""Incremental refresh, exports and scratch space."""

import pytest
from pyspark.sql import functions as F

from panelwright.plans.catalog import QUERIES
from panelwright import session
from panelwright.sources import feeds, manifest, schemas, sinks
from panelwright.streaming import refresh

SCHEMA = "player_id int, event int, total_points double"


def _schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def _fixtures(spark, last):
    return spark.range(1, last + 2).select(
        F.col("id").cast("int").alias("event"), (F.col("id") <= last).alias("finished")
    )


def test_refresh_follows_the_mark(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "table")
    where = dict(landing=landing, schema=_schema(spark), table=table, checkpoint=str(tmp_path / "cp"))
    mark = str(tmp_path / "mark")

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    def table_rows():
        rows = refresh.read_refreshed(spark, table, ["player_id", "event"])
        return sorted((r.player_id, r.event, r.total_points) for r in rows.collect())

    land([(1, 1, 5.0), (2, 1, 3.0)])
    assert refresh.incremental_refresh(spark, _fixtures(spark, 1), mark, **where)
    assert refresh.read_mark(spark, mark) == 1
    assert table_rows() == [(1, 1, 5.0), (2, 1, 3.0)]

    land([(1, 2, 9.0), (2, 1, 4.0)])  # a new period and a corrected row
    assert not refresh.incremental_refresh(spark, _fixtures(spark, 1), mark, **where)
    assert len(table_rows()) == 2
    assert refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, **where)
    assert table_rows() == [(1, 1, 5.0), (1, 2, 9.0), (2, 1, 4.0)]

    land([(3, 2, 1.0)])
    assert refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, force=True, **where)
    assert len(table_rows()) == 4


def test_half_played_period(spark):
    fixtures = spark.createDataFrame([(1, True), (2, True), (2, False)], "event int, finished boolean")
    assert refresh.newest_finished(fixtures) == 2
    assert refresh.newest_finished(fixtures, complete=True) == 1
    assert refresh.newest_finished(fixtures.filter("event = 9")) == 0


def test_newest_export_by_number(spark, tmp_path):
    base = str(tmp_path / "out")
    for period in (9, 10, 31):
        df = spark.createDataFrame([(f"p{period}", float(period))], "Player string, PredPts double")
        sinks.export_all({"predictions": df}, base, period)
    sinks.export_all({"predictions": df}, base, 31)
    schema = spark.createDataFrame([], "Player string, PredPts double, gw int").schema
    rows = feeds.read_csv(spark, f"{base}/predictions", schema)
    assert rows.count() == 3
    newest = feeds.latest_partition(rows, "gw")
    assert [tuple(r) for r in newest.collect()] == [("p31", 31.0, 31)]
    assert [r.Player for r in feeds.latest_partition(rows, "gw", 9).collect()] == ["p9"]


def test_shared_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_dir(spark) == configured.rstrip("/")
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first != second and first.startswith(session.shared_dir(spark))


def test_shared_dir_is_demanded_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_materialise_cuts_lineage(spark):
    df = session.materialise(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 10 and "Range" not in plan


def test_mark_waits_for_late_files(spark, tmp_path):
    landing, mark = tmp_path / "in", str(tmp_path / "mark")
    landing.mkdir()
    where = dict(landing=str(landing), schema=_schema(spark), table=str(tmp_path / "table"), checkpoint=str(tmp_path / "cp"))
    assert not refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, **where)
    assert refresh.read_mark(spark, mark) == -1
    spark.createDataFrame([(1, 1, 5.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
    assert refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, **where)
    assert refresh.read_mark(spark, mark) == 1
    spark.createDataFrame([(1, 2, 6.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
    assert refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, **where)
    assert refresh.read_mark(spark, mark) == 2


def test_refresh_query_reads_a_folder_table(spark, sf_dir, tmp_path):
    for name in ("events", "customer", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = QUERIES["incremental_refresh"](spark, str(tmp_path))
    assert rows.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_killed_between_data_and_mark(spark, tmp_path, monkeypatch):
    """The data has landed, the mark hasn't: the last whole mark holds, and the next run catches up."""
    landing, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    where = dict(landing=landing, schema=_schema(spark), table=str(tmp_path / "table"), checkpoint=str(tmp_path / "cp"))

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    land([(1, 1, 5.0)])
    assert refresh.incremental_refresh(spark, _fixtures(spark, 1), mark, **where)
    land([(1, 2, 6.0)])
    with monkeypatch.context() as patch:
        patch.setattr(refresh, "write_mark", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, **where)
    assert refresh.read_mark(spark, mark) == 1
    assert refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, **where)
    assert refresh.read_mark(spark, mark) == 2
    assert refresh.read_refreshed(spark, where["table"]).count() == 2
    assert not refresh.incremental_refresh(spark, _fixtures(spark, 2), mark, **where)


def test_a_torn_mark_is_no_mark(spark, tmp_path):
    mark = tmp_path / "mark"
    refresh.write_mark(spark, str(mark), 4)
    refresh.write_mark(spark, str(mark), 7, 7, 3)
    (mark / "part-torn.json").write_text('{"last_finished_gw": 9, "ne')
    assert refresh.read_mark(spark, str(mark)) == 7
    refresh.write_mark(spark, str(mark), 5)  # a smaller mark may follow
    assert refresh.read_mark(spark, str(mark)) == 5


def _folders(df):
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


@pytest.mark.parametrize("versioned", [False, True])
def test_exports_are_found_by_their_manifest(spark, tmp_path, monkeypatch, versioned):
    base = str(tmp_path / "out")

    def export(period, value):
        tables = {"a": spark.createDataFrame([(1, value)], "id bigint, x double"), "b": spark.createDataFrame([(2, "q\"u")], "id bigint, t string")}
        return sinks.export_all(tables, base, period, {"a": "json"}, versioned)

    assert manifest.read_export(spark, base, "a") is None
    export(9, 1.0)
    export(10, 2.0)
    newest = manifest.read_export(spark, base, "a")
    assert [tuple(r) for r in newest.collect()] == [(1, 2.0, 10)] and _folders(newest) == {"gw=10"}
    assert [tuple(r) for r in manifest.read_export(spark, base, "b").collect()] == [(2, 'q"u', 10)]
    assert [r.x for r in manifest.read_export(spark, base, "a", 9).collect()] == [1.0]
    with monkeypatch.context() as patch:  # an export that dies before its manifest is not seen as the newest
        patch.setattr(manifest, "append", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            export(11, 3.0)
    assert manifest.newest_export(spark, base, "a")[0] == 10
    export(10, 4.0)
    assert [r.x for r in manifest.read_export(spark, base, "a").collect()] == [4.0]


def test_the_newest_period_is_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 12) for k in range(60)], "id bigint, gw int")
    path = sinks.write_by_period(rows, str(tmp_path / "t"), "gw")
    newest = feeds.read_newest(spark, path, rows.schema, "gw")
    assert {r.gw for r in newest.collect()} == {11} and newest.count() == 5
    assert "PartitionFilters: [isnotnull(gw" in newest._jdf.queryExecution().executedPlan().toString()


def test_ids_beyond_32_bits_survive(spark, tmp_path):
    big = 6_000_000_000
    (tmp_path / "history").mkdir()
    (tmp_path / "history" / f"{big}.json").write_text(f'{{"history": [{{"fixture": {big + 1}, "round": 3, "total_points": 2}}]}}')
    (tmp_path / "bootstrap.json").write_text(f'{{"elements": [{{"id": {big}, "team": {big + 2}, "web_name": "x"}}]}}')
    (tmp_path / "fixtures.json").write_text(f'[{{"id": {big + 1}, "event": 3, "team_h": {big + 2}, "team_a": {big + 3}}}]')
    history = feeds.read_entity_history(spark, str(tmp_path / "history"), schemas.HISTORY).first()
    assert (history.player_id, history.fixture) == (big, big + 1)
    player = feeds.read_json_array(spark, str(tmp_path / "bootstrap.json"), "elements", schemas.PLAYERS).first()
    match = feeds.read_json_records(spark, str(tmp_path / "fixtures.json"), schemas.FIXTURES).first()
    assert (player.id, player.team, match.id, match.team_a) == (big, big + 2, big + 1, big + 3)


def test_a_scope_leaves_no_scratch_behind(spark, sf_dir):
    import os

    folder = f"{session.shared_dir(spark).removeprefix('file://')}/panelwright"
    session.materialise(spark.range(3), "kept")
    before = set(os.listdir(folder))
    with session.scope(spark):
        assert QUERIES["column_stats"](spark, sf_dir).count() > 0
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
    with pytest.raises(ValueError), session.scope(spark):
        session.materialise(spark.range(3), "lost")
        raise ValueError
    assert set(os.listdir(folder)) == before
