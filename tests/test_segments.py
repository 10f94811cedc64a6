"""Scans over time segments against whole-series scans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import segments as S
from barloom.functions.columns import ewm_mean
from barloom.operators import features
from barloom.operators.joins import asof_backward


def series(seed, sizes, holes=0.2):
    """Symbols of several lengths with NULLs, whole empty stretches among them, and gaps in time."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        at = np.cumsum(rng.choice([1, 1, 1, 5, 200], n))
        x = rng.normal(10, 3, n)
        x[rng.random(n) < holes] = np.nan
        x[n // 3 : n // 2] = np.nan
        if k % 2:
            x[: n // 4] = np.nan
        rows += [(f"s{k}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(t)), None if np.isnan(v) else float(v)) for t, v in zip(at, x)]
    return rows


SCHEMA = "symbol string, date timestamp_ntz, x double"


def segmented(df, hours):
    return df.withColumn(S.SEG, F.floor(S.wall_seconds(F.col("date")) / (hours * 3600)).cast("long"))


@pytest.mark.parametrize("hours, stretch", [(7, 500), (40, 3), (300, 500), (100_000, 4)])
def test_means_equal_pandas(spark, monkeypatch, hours, stretch):
    monkeypatch.setattr(S, "STRETCH", stretch)
    rows = series(hours, [400, 250, 3, 1])
    specs = [S.Ewm("x", 1 / 14, "a", 14), S.Ewm("x", 2 / 27, "b"), S.Ewm("x", 0.9, "c", 2), S.Ewm("x", 0.002, "d"), S.Ewm("x", 1.0, "e")]
    got = S.with_ewm(segmented(spark.createDataFrame(rows, SCHEMA).repartition(5), hours), specs).toPandas().sort_values(["symbol", "date"])
    for s, g in got.groupby("symbol"):
        x = pd.Series([v for k, _, v in rows if k == s], dtype=float)
        for m in specs:
            # Missing values leave the mean as it was.
            known = x.dropna().ewm(alpha=m.alpha, adjust=False, min_periods=m.least).mean().reindex(x.index).ffill()
            assert np.allclose(g[m.out].astype(float), known, rtol=1e-11, equal_nan=True), (s, m)


def test_previous_and_last_known_values(spark):
    rows = series(3, [300, 40, 1])
    df = segmented(spark.createDataFrame(rows, SCHEMA), 11)
    got = S.with_previous(df, {"p": "x"}).toPandas().sort_values(["symbol", "date"])
    last = S.with_last_known(df, "x", ["date"]).toPandas().sort_values(["symbol", "date"])
    for s, g in got.groupby("symbol"):
        x = pd.Series([v for k, _, v in rows if k == s], dtype=float)
        assert np.allclose(g.p.astype(float), x.shift(), equal_nan=True)
        assert np.allclose(last[last.symbol == s].x.astype(float), x.ffill(), equal_nan=True)


def test_indicators_and_asof_equal_whole_scans(spark):
    rng = np.random.default_rng(1)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(c), float(c + rng.uniform()), float(c - rng.uniform())) for s in "abc" for k, c in enumerate(100 + rng.normal(0, 1, 120).cumsum())]
    df = spark.createDataFrame(rows, "symbol string, date timestamp_ntz, close double, high double, low double")
    seg = F.floor(S.wall_seconds(F.col("date")) / (9 * 86400)).cast("long")
    one, other = (features.add_indicators(df, segment=s).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for s in (None, seg))
    assert sorted(one.columns) == sorted(other.columns)
    for c in features.INDICATORS:
        assert np.allclose(one[c].astype(float), other[c].astype(float), equal_nan=True, rtol=1e-10)
    right = df.where("day(date) % 5 = 0 and symbol <> 'c'").selectExpr("symbol", "date + interval 1 hour as date", "close as v")
    a, b = (asof_backward(df.select("symbol", "date", "close"), right, ["v"], segment=s).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for s in (None, seg))
    assert a.equals(b) and a.v.notna().any()


def test_segments_follow_the_longest_series(spark):
    df = spark.range(1000).selectExpr("'a' as symbol", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) as date", "id as x").unionAll(spark.sql("select 'b', timestamp_ntz '2024-01-05', 1"))
    assert S.segment_of(df, 1000) is None and S.segment_of(df.limit(0), 10) is None
    seg = S.segment_of(df, 100)
    found = df.withColumn("s", seg).groupBy("symbol", "s").count().collect()
    assert max(r["count"] for r in found) <= 101 and len(found) >= 10
    assert df.withColumn("s", seg).selectExpr("s < lag(s) over (partition by symbol order by date) as back").where("back").isEmpty()


def test_rows_are_shuffled_once_by_symbol_and_segment(spark, capsys):
    df = segmented(spark.range(5000).selectExpr("if(id % 100 = 0, 'b', 'a') as symbol", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) as date", "cast(id as double) as x").repartition(3), 100)
    S.with_ewm(df, [S.Ewm("x", 0.1, "y")]).explain()
    dealt = [line.split("hashpartitioning(")[1].split(")")[0] for line in capsys.readouterr().out.split("\n") if "Exchange hashpartitioning(" in line]
    # Rows by (symbol, segment) in both branches, the same exchange; stretches by symbol; carries, unless they are sent, as rows.
    assert sum("_seg" not in d for d in dealt) == 1 and 2 <= sum("_seg" in d for d in dealt) <= 3
    sizes = df.repartition(8, "symbol", S.SEG).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4  # one symbol, many tasks


def test_long_series_keep_their_precision(spark):
    """As the whole-series mean, over 20,000 rows in 50 segments."""
    df = spark.range(20_000).selectExpr("'a' as symbol", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) as date", "sin(id) * 5 + id % 7 as x")
    got = S.with_ewm(segmented(df, 400), [S.Ewm("x", 2 / 27, "y")]).select("date", "y")
    want = ewm_mean(df, "x", 2 / 27, "z").select("date", "z")
    assert got.join(want, "date").where("abs(y - z) > 1e-9 * abs(z)").isEmpty() and got.count() == 20_000
