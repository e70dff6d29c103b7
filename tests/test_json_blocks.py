"""Records of large JSON documents against the whole-document parser."""

import json
import random

import pytest

from panelwright.sources import feeds, json_blocks, schemas

SCHEMA = "id bigint, name string, tags array<string>, nested array<struct<x: int>>, more struct<y: string, z: struct<w: int>>"


def hard_record(rng, k):
    text = rng.choice(['plain', 'quote " here', 'brace } { ] [', 'back\\slash', 'end\\', '"elements":[{', "äöü € 🎉", "line\nbreak", ""])
    return {
        "id": 6_000_000_000 + k, "name": text, "tags": [rng.choice(["}", '"', "a,b", ""]) for _ in range(rng.randint(0, 3))],
        "nested": [{"x": i} for i in range(rng.randint(0, 4))] or None, "more": {"y": text, "z": {"w": k}} if k % 3 else None,
    }


def rows_of(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def schema_of(spark):
    return spark.createDataFrame([], SCHEMA).schema


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_and_fields(spark, tmp_path, small_ranges, indent):
    rng = random.Random(1)
    want = [hard_record(rng, k) for k in range(60)]
    other = [hard_record(rng, 1000 + k) for k in range(9)]
    document = {
        "count": 60, "names": ["a", "{", '"elements":['], "meta": {"list": [{"x": 1}, {"x": {"y": 2}}], "deep": {"er": {"id": 1}}},
        "first": other, "elements": want, "empty": [], "settings": {"id": 5, "o": {"id": 6}}, "last": other,
    }
    (tmp_path / "object.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False))
    (tmp_path / "array.json").write_text(json.dumps(want, indent=indent))
    schema = schema_of(spark)
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "array.json")).rdd.getNumPartitions() > 10
    expected = sorted(({**r} for r in want), key=str)
    got = json_blocks.read_records(spark, str(tmp_path / "object.json"), schema, "elements")
    assert rows_of(got) == expected
    assert rows_of(json_blocks.read_records(spark, str(tmp_path / "array.json"), schema)) == expected
    assert len(rows_of(json_blocks.read_records(spark, str(tmp_path / "object.json"), schema, "last"))) == 9
    for none in ("empty", "absent", "meta", "settings", "list"):
        assert json_blocks.read_records(spark, str(tmp_path / "object.json"), schema, none).isEmpty()


def test_folders_broken_and_empty_documents(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    folder = tmp_path / "docs"
    folder.mkdir()
    records = [hard_record(rng, k) for k in range(12)]
    (folder / "a.json").write_text(json.dumps(records[:6]))
    (folder / "b.json").write_text(json.dumps(records[6:])[:-40])  # breaks off within the last record
    (folder / "c.json").write_text("")
    (folder / "d.json").write_text("[]")
    got = rows_of(json_blocks.read_records(spark, str(folder), schema_of(spark)))
    assert got == sorted(records[:11], key=str)


def test_feeds_read_documents_by_many_tasks(spark, landing, small_ranges):
    players = feeds.read_json_array(spark, f"{landing}/bootstrap.json", "elements", schemas.PLAYERS)
    matches = feeds.read_json_records(spark, f"{landing}/fixtures.json", schemas.FIXTURES)
    document = json.load(open(f"{landing}/bootstrap.json"))
    assert sorted(r.id for r in players.collect()) == [p["id"] for p in document["elements"]]
    assert players.rdd.getNumPartitions() >= 1 and matches.count() == len(json.load(open(f"{landing}/fixtures.json")))
    assert feeds.read_json_array(spark, f"{landing}/bootstrap.json", "teams", schemas.TEAMS).count() == 6
