"""Scalar rules on edge rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright import fixed_values as fixed
from panelwright.functions import scalars, text
from panelwright.operators import clean, features, scoring


def one(spark, column, schema="x double", value=None):
    return spark.createDataFrame([(value,)], schema).select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "raw,want",
    [("3.5", 3.5), (" 7 ", 7.0), ("abc", None), ("", None), (None, None), ("NaN", None), ("1d", None),
     ("2.5f", None), ("1e3", 1000.0), ("-4", -4.0), ("inf", float("inf"))],
)
def test_to_number(spark, raw, want):
    assert one(spark, scalars.to_number("x"), "x string", raw) == want


@pytest.mark.parametrize("value,want", [(True, True), (False, False), (None, False)])
def test_is_true_boolean(spark, value, want):
    assert one(spark, scalars.is_true("x"), "x boolean", value) is want


@pytest.mark.parametrize("value,want", [("True", True), ("TRUE", True), ("false", False), ("1", False), (None, False)])
def test_is_true_text(spark, value, want):
    assert one(spark, scalars.is_true("x"), "x string", value) is want


@pytest.mark.parametrize("value,want", [(None, 3.0), (0.0, 3.0), (2.0, 2.0), (-1.0, -1.0)])
def test_falsy_default(spark, value, want):
    assert one(spark, scalars.falsy_default("x", 3), value=value) == want


@pytest.mark.parametrize("value,want", [(None, None), (-1.0, 0.0), (5.0, 5.0), (11.0, 10.0)])
def test_clip(spark, value, want):
    assert one(spark, scalars.clip("x", 0.0, 10.0), value=value) == want


def test_round_half_even_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = [0.125, 2.675, 0.285, 1.005, -0.125, 0.5, 1.5] + list(np.round(rng.random(3000) * 40, 3))
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = df.select("x", scalars.round_half_even("x", 2).alias("y")).toPandas()
    assert (got["y"] == np.round(got["x"], 2)).all()


@pytest.mark.parametrize(
    "status,chance,minutes,want",
    [("i", 100.0, 90.0, 0.0), ("u", None, 90.0, 0.0), ("s", 75.0, 90.0, 0.0), ("d", 75.0, 0.0, 0.75),
     ("a", 0.0, 90.0, 0.0), ("a", None, 75.0, 1.0), ("a", None, 74.9, 0.9), ("a", None, 60.0, 0.9),
     ("a", None, 45.0, 0.75), ("a", None, 30.0, 0.55), ("a", None, 15.0, 0.35), ("a", None, 14.0, 0.10),
     (None, None, None, 0.10), (None, 50.0, None, 0.5)],
)
def test_availability(spark, status, chance, minutes, want):
    df = spark.createDataFrame([(status, chance, minutes)], "s string, c double, m double")
    assert df.select(scalars.availability("s", "c", "m").alias("y")).first().y == want


@pytest.mark.parametrize(
    "momentum,points,want",
    [(0.31, 4.1, fixed.SIGNAL_RISE), (0.3, 5.0, fixed.SIGNAL_STABLE), (0.5, 4.0, fixed.SIGNAL_STABLE),
     (-0.31, 9.0, fixed.SIGNAL_FALL), (-0.3, 9.0, fixed.SIGNAL_STABLE), (0.9, 0.9, fixed.SIGNAL_FALL),
     (0.0, 1.0, fixed.SIGNAL_STABLE), (None, None, fixed.SIGNAL_STABLE)],
)
def test_price_signal(spark, momentum, points, want):
    df = spark.createDataFrame([(momentum, points)], "m double, p double")
    assert df.select(scalars.price_signal("m", "p").alias("y")).first().y == want


@pytest.mark.parametrize(
    "raw,n,group,want",
    [(5.0, 0.0, 1, 0.0), (5.0, 1.0, 1, 5.0), (5.0, 2.0, 1, 8.0), (15.0, 2.0, 4, 20.0), (5.0, 2.0, 9, 5.0),
     (5.0, 3.0, 3, 9.0)],
)
def test_adjusted_raw(spark, raw, n, group, want):
    df = spark.createDataFrame([(raw, n, group)], "r double, n double, g int")
    assert df.select(scoring.adjusted_raw("r", "n", "g").alias("y")).first().y == pytest.approx(want)


def test_masked_keeps_null(spark):
    df = spark.createDataFrame([(None, True), (2.0, True), (2.0, False), (2.0, None)], "x double, c boolean")
    got = [r.y for r in df.select(scalars.masked("x", F.col("c")).alias("y")).collect()]
    assert got == [None, 2.0, 0.0, 0.0]


def test_value_ratio_floor_and_null(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, 4.0), (2.0, None)], "p double, c double")
    assert [r.y for r in df.select(scalars.value_ratio("p", "c").alias("y")).collect()] == [20.0, 0.5, None]


def test_momentum_all_equal_and_missing(spark):
    flat = spark.createDataFrame([(1, 5, 5), (2, None, None)], "id int, transfers_in_event long, transfers_out_event long")
    assert {r.transfer_momentum_norm for r in features.momentum(flat).collect()} == {0.0}
    bare = spark.createDataFrame([(1,)], "id int")
    assert features.momentum(bare).first().transfer_momentum_norm == 0.0
    some = spark.createDataFrame([(1, 9, 1), (2, 0, 4), (3, None, 1)], "id int, transfers_in_event long, transfers_out_event long")
    got = {r.id: r.transfer_momentum_norm for r in features.momentum(some).collect()}
    assert got == {1: 1.0, 2: -0.5, 3: -0.125}


def test_aliases_reject_unknown(spark):
    df = spark.createDataFrame([("forward",), ("Att",), ("coach",), (None,)], "p string")
    assert [r.p for r in clean.canonical_groups(df, "p", fixed.POSITION_ALIASES).collect()] == ["FWD", "FWD"]


def test_feature_lists():
    assert len(features.common_features()) == 108
    assert [len(features.feature_columns(g)) for g in (1, 2, 3, 4, 9)] == [111, 110, 110, 110, 108]


def test_keywords_match_inside_words(spark):
    df = spark.createDataFrame([("the whole story",), ("Bench?",), ("rain",), (None,)], "t string")
    plain = [r.y for r in df.select(text.matches_any("t", fixed.TOPIC_KEYWORDS).alias("y")).collect()]
    strict = [r.y for r in df.select(text.matches_any("t", ["who"], True).alias("y")).collect()]
    assert plain == [True, True, False, False] and strict == [False] * 4


def test_format_line_does_not_cut(spark):
    df = spark.createDataFrame([("A name that is longer than twenty", 5.5)], "n string, v double")
    line = df.select(text.format_line("n", "v", "v", "v", "v", "v").alias("y")).first().y
    assert line == "  A name that is longer than twenty Price: £5.5  PredPts: 5.5  FDR: 5.5  Home: 5.5  Value: 5.5"
    short = spark.createDataFrame([("Bob", 1)], "n string, v int")
    assert short.select(text.format_line("n", "v", "v", "v", "v", "v").alias("y")).first().y.startswith(
        "  Bob                  Price: £1  "
    )


def test_period_from_name_is_numeric(spark):
    df = spark.createDataFrame([("best_gw9.csv",), ("best_gw31.csv",), ("best_gw10.csv",), ("other",)], "n string")
    assert [r.y for r in df.select(text.period_from_name("n").alias("y")).collect()] == [9, 31, 10, None]


def test_numeric_columns_by_type(spark):
    df = spark.createDataFrame([("1.5", 2, float("nan"))], "a string, b int, c double")
    got = clean.numeric_columns(df, ["a", "b", "c", "d"], default=0.0).first()
    assert got.asDict() == {"a": 1.5, "b": 2.0, "c": 0.0, "d": 0.0}
    assert pd.isna(clean.numeric_columns(df, ["c"]).first().c)
