"""Window features against pandas, on panels with gaps, NULLs and long histories."""

import numpy as np
import pandas as pd
import pytest

from panelwright.functions import windows
from panelwright.operators import features


def _random_panel(seed, n_entities=7, n_periods=40, nulls=0.0):
    rng = np.random.default_rng(seed)
    rows = [
        (e, p, float(np.round(rng.normal(3, 5), 2)), float(rng.integers(0, 4)))
        for e in range(n_entities)
        for p in range(1, n_periods + 1)
    ]
    df = pd.DataFrame(rows, columns=["player_id", "event", "a", "b"])
    df.loc[rng.random(len(df)) < nulls, "a"] = np.nan
    return df


def _expected(df, stats, span=5):
    out = df.copy()
    for s in stats:
        lagged = df.groupby("player_id")[s].shift(1)
        by = lagged.groupby(df["player_id"])
        out[f"{s}_mean5"] = by.transform(lambda x: x.rolling(5, min_periods=1).mean())
        out[f"{s}_sum5"] = by.transform(lambda x: x.rolling(5, min_periods=1).sum())
        out[f"{s}_std5"] = by.transform(lambda x: x.rolling(5, min_periods=1).std()).fillna(0)
        out[f"{s}_mean19"] = by.transform(lambda x: x.rolling(19, min_periods=1).mean())
        out[f"{s}_trend"] = out[f"{s}_mean5"] - out[f"{s}_mean19"]
        out[f"{s}_ewm"] = by.transform(lambda x: x.ewm(span=span, min_periods=1).mean())
    return out


def _spark_frame(spark, df):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(
        [(int(e), int(p), *rest) for e, p, *rest in rows], "player_id int, event int, a double, b double"
    )


def _compare(got, want):
    key = ["player_id", "event"]
    got = got.toPandas().sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    for c in want.columns:
        np.testing.assert_allclose(
            got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-7, equal_nan=True, err_msg=c
        )


@pytest.mark.parametrize("nulls,dense", [(0.0, True), (0.0, False), (0.3, False)])
def test_family_equals_pandas(spark, nulls, dense):
    df = _random_panel(1, nulls=nulls)
    got = features.rolling_features(_spark_frame(spark, df), "player_id", "event", ["a", "b", "none"], dense=dense)
    _compare(got, _expected(df, ["a", "b"]))


def test_ewm_over_many_blocks(spark):
    """Blocks of 120 rows over 2,000 periods: nothing overflows and nothing is lost."""
    df = _random_panel(2, n_entities=2, n_periods=2000, nulls=0.1)
    got = features.ewm_features(_spark_frame(spark, df), "player_id", "event", ["a"], block_rows=120)
    want = _expected(df, ["a"])[["player_id", "event", "a", "b", "a_ewm"]]
    _compare(got, want)


def test_ewm_default_block_is_safe(spark):
    df = _random_panel(3, n_entities=1, n_periods=4000)
    got = features.ewm_features(_spark_frame(spark, df), "player_id", "event", ["a"], dense=True)
    _compare(got, _expected(df, ["a"])[["player_id", "event", "a", "b", "a_ewm"]])


def test_no_leakage(spark):
    """A changed value shows in later rows only."""
    df = _random_panel(4, n_entities=3)
    changed = df.copy()
    changed.loc[(changed.player_id == 1) & (changed.event == 20), "a"] += 1000
    frames = []
    for version in (df, changed):
        out = features.rolling_features(_spark_frame(spark, version), "player_id", "event", ["a"])
        out = features.previous_values(out, "player_id", "event", ["a"]).drop("a")
        frames.append(out.toPandas().sort_values(["player_id", "event"]).reset_index(drop=True))
    before, after = frames
    same = (before.fillna(-1e9) - after.fillna(-1e9)).abs().max(axis=1) < 1e-9
    touched = before[~same]
    assert len(touched) and (touched.player_id == 1).all() and (touched.event > 20).all()


def test_single_period_entity(spark):
    got = features.rolling_features(
        spark.createDataFrame([(1, 5, 2.0)], "player_id int, event int, a double"), "player_id", "event", ["a"]
    ).first()
    assert got.a_mean5 is None and got.a_sum5 is None and got.a_std5 == 0.0 and got.a_ewm is None


def test_include_current(spark):
    df = _random_panel(5, n_entities=2)
    got = features.rolling_features(
        _spark_frame(spark, df), "player_id", "event", ["a"], include_current=True
    ).toPandas()
    want = df.groupby("player_id")["a"].transform(lambda x: x.rolling(5, min_periods=1).mean())
    ewm = df.groupby("player_id")["a"].transform(lambda x: x.ewm(span=5).mean())
    got = got.sort_values(["player_id", "event"])
    np.testing.assert_allclose(got["a_mean5"], want, atol=1e-9)
    np.testing.assert_allclose(got["a_ewm"], ewm, atol=1e-9)


def test_one_exchange_for_the_family(spark):
    df = _spark_frame(spark, _random_panel(6))
    out = features.rolling_features(df, "player_id", "event", ["a", "b"])
    out = features.previous_values(out, "player_id", "event", ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_group_start(spark):
    rows = [(1, 1, "x"), (1, 2, "x"), (1, 3, None), (1, 4, None), (1, 5, "x"), (2, 1, None)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    out = df.withColumn("s", windows.is_group_start("v", ["k"], ["o"])).orderBy("k", "o").collect()
    assert [r.s for r in out] == [True, False, True, False, True, True]
