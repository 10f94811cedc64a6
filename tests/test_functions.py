import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import columns as C
from barloom.operators import features


def panel(spark, values, symbol="a"):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(symbol, start + dt.timedelta(days=k), None if v is None else float(v)) for k, v in enumerate(values)], "symbol string, date timestamp_ntz, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


@pytest.mark.parametrize(
    "values, expected",
    [([None, 1, None, None, 4, None, 6, None], [1, 1, 2, 3, 4, 5, 6, 6]), ([None, None, None], [None, None, None]), ([5], [5])],
)
def test_linear_fill(spark, values, expected):
    assert column(C.linear_fill(panel(spark, values), ["x"]), "x") == expected


@pytest.mark.parametrize("n", [3, 40, 1800])
@pytest.mark.parametrize("alpha", [1 / 14, 2 / 13])
def test_ewm_matches_pandas_at_any_length(spark, n, alpha):
    x = np.random.default_rng(n).normal(10, 3, n)
    got = column(C.ewm_mean(panel(spark, x), "x", alpha, "y"), "y")
    assert np.allclose(got, pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), rtol=1e-12)


def test_ewm_leading_null_and_least(spark):
    x = [None, *range(1, 20)]
    got = column(C.ewm_mean(panel(spark, x), "x", 1 / 14, "y", least=14), "y")
    want = pd.Series([np.nan, *range(1, 20)]).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert [g is None for g in got] == list(want.isna())
    assert np.allclose([g for g in got if g is not None], want.dropna())


def test_rolling_std_needs_enough_values(spark):
    x = [1.0, 2.0, None, 4.0, 5.0, 6.0, 9.0]
    got = column(panel(spark, x).withColumn("y", C.rolling_std(F.col("x"), C.by_symbol(), 20)), "y")
    want = pd.Series(x).rolling(20, min_periods=5).std()
    assert [g is None for g in got] == list(want.isna())
    assert np.allclose([g for g in got if g is not None], want.dropna())


def test_clip_and_log_keep_nulls(spark):
    df = panel(spark, [None, -1, 0, 2]).select("symbol", "date", C.clip(F.col("x"), 0.0, 1.0).alias("c"), C.safe_log(F.col("x")).alias("l"))
    assert column(df, "c") == [None, 0.0, 0.0, 1.0]
    assert column(df, "l")[0] is None and column(df, "l")[1] == pytest.approx(np.log(1e-12))


def test_rsi_atr_macd_match_pandas(spark):
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(0, 1, 90).cumsum()
    p = pd.DataFrame({"symbol": "a", "date": pd.date_range("2024-01-01", periods=90), "close": close, "high": close + rng.uniform(0, 1, 90), "low": close - rng.uniform(0, 1, 90)})
    df = features.add_indicators(spark.createDataFrame(p))
    got = df.orderBy("date").toPandas()
    d = p.close.diff()
    up, down = (z.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for z in (d.clip(lower=0), -d.clip(upper=0)))
    assert np.allclose(got.rsi_14, 100 - 100 / (1 + up / (down + 1e-12)), equal_nan=True)
    tr = pd.concat([p.high - p.low, (p.high - p.close.shift()).abs(), (p.low - p.close.shift()).abs()], axis=1).max(axis=1)
    assert np.allclose(got.atr_14, tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), equal_nan=True)
    line = p.close.ewm(span=12, adjust=False).mean() - p.close.ewm(span=26, adjust=False).mean()
    assert np.allclose(got.macd_line, line) and np.allclose(got.macd_signal, line.ewm(span=9, adjust=False).mean())


def test_robust_scale_guards_constant_columns(spark):
    df = features.robust_scale(panel(spark, [3, 3, 3]), ["x"])
    assert column(df, "x_scaled") == [0.0, 0.0, 0.0]
