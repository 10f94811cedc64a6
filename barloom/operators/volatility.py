"""Volatility forecasts by cluster factor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import by_symbol, finite, rolling_std
from barloom.functions.segments import wall_seconds
from barloom.operators.joins import asof_backward
from barloom.operators.regimes import UNKNOWN, principal_axes

DEFAULT_VOL = 0.01
GARCH_LEAST = 30


def ewma_vol(returns: DataFrame, decay: float, horizon: int, key: str = "symbol", date: str = "date", value: str = "log_return") -> DataFrame:
    """One forecast for each key: the variance recursion v = decay v + (1 - decay) r^2 from the population
    variance, in closed form, times the horizon. Terms too old to show in a double underflow to nothing."""
    known = returns.where(finite(F.col(value)))
    order, whole = Window.partitionBy(key).orderBy(F.desc(date)), Window.partitionBy(key)
    age = known.select(key, value, (F.row_number().over(order) - 1).alias("age"), F.count("*").over(whole).alias("n"))
    variance = F.pow(F.lit(decay), F.max("n")) * F.var_pop(value) + (1 - decay) * F.sum(F.pow(F.lit(decay), F.col("age")) * F.col(value) * F.col(value))
    return age.groupBy(key).agg(F.sqrt(variance * horizon).alias("vol_forecast"))


def ewma_of(x: np.ndarray, decay: float, horizon: int) -> float:
    if not len(x):
        return float("nan")
    weights = decay ** np.arange(len(x) - 1, -1, -1)
    return float(np.sqrt((decay ** len(x) * x.var() + (1 - decay) * (weights * x * x).sum()) * horizon))


def garch_fit(r2: np.ndarray) -> tuple[float, float, float, float]:
    """(omega, alpha, beta, next variance) of the zero-mean GARCH(1,1) of greatest Gaussian likelihood, from squared
    returns. The recursion starts at a decaying mean of the first 75. All candidates of a grid over the long-run
    variance, alpha and alpha + beta run through the recursion together; the grid is drawn in on the best again
    and again, its bounds kept."""
    first = r2[:75]
    decay = 0.94 ** np.arange(len(first))
    start, level = float((first * decay).sum() / decay.sum()), float(r2.mean())
    if not level > 0:
        return 0.0, 0.0, 0.0, 0.0

    def run(scale: np.ndarray, alpha: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        omega, beta = level * np.exp(scale) * (1 - total), total - alpha
        v, loss = np.full(len(scale), max(start, 1e-12)), np.zeros(len(scale))
        for x in r2:
            loss += np.log(v) + x / v
            v = np.maximum(omega + alpha * x + beta * v, 1e-12)
        return loss, v

    # log of the long-run variance over the sample's, alpha as a share of alpha + beta, log of 1 - alpha - beta
    low, high = np.array([-3.0, 0.0, -9.0]), np.array([3.0, 1.0, 0.0])
    centre, reach = (low + high) / 2, (high - low) / 2
    for _ in range(20):
        axes = [np.clip(c + h * np.linspace(-1, 1, 7), a, b) for c, h, a, b in zip(centre, reach, low, high)]
        scale, share, rest = (g.ravel() for g in np.meshgrid(*axes, indexing="ij"))
        total = 1 - np.exp(rest)
        loss, v = run(scale, share * total, total)
        k = int(loss.argmin())
        centre, reach = np.array([scale[k], share[k], rest[k]]), reach * 0.7
    scale, share, total = scale[k], share[k], total[k]
    return float(level * np.exp(scale) * (1 - total)), float(share * total), float(total * (1 - share)), float(v[k])


def garch_of(x: np.ndarray, decay: float, horizon: int) -> float:
    """The mean variance over the horizon of a GARCH(1,1) fitted on percent returns, as a per-step deviation; the
    exponential forecast with too few returns."""
    x = x[np.isfinite(x)]
    if len(x) < GARCH_LEAST:
        return ewma_of(x, decay, horizon)
    omega, alpha, beta, v = garch_fit((x * 100) ** 2)
    total = 0.0
    for _ in range(horizon):
        total += v
        v = omega + (alpha + beta) * v
    return float(np.sqrt(total / horizon) / 100)


def lookback_members(panel: DataFrame, members: DataFrame, days: int) -> DataFrame:
    """Panel rows (date, symbol, log_return) of each member (on, symbol, regime) in the `days` days up to `on`, both
    ends included. Both sides are cut into buckets of `days` days, so a row meets the members of two buckets only."""
    width = days * 86400
    at = F.floor(F.unix_timestamp(F.col("on").cast("timestamp")) / width)
    spread = members.withColumn("_b", F.explode(F.array(at - 1, at)))
    rows = panel.select("date", "symbol", "log_return").withColumn("_b", F.floor(F.unix_timestamp(F.col("date").cast("timestamp")) / width))
    near = rows.join(spread, ["symbol", "_b"]).drop("_b")
    return near.where((F.col("date") <= F.col("on")) & (F.col("date") >= F.col("on") - F.expr(f"INTERVAL {days} DAYS")))


def lookback_blocks(panel: DataFrame, members: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Panel rows (_b, regime, date, symbol, log_return) and members (_b_, regime_, on_, symbol_), such that all rows of a
    member's lookback lie in its block of `days` days and regime. A row goes to its own block and the next, once for each
    regime that its symbol has there, however many lookbacks overlap."""
    width = days * 86400
    asked = members.withColumn("_b", F.floor(wall_seconds(F.col("on")) / width))
    rows = panel.select("date", "symbol", "log_return").withColumn("_b", F.floor(wall_seconds(F.col("date")) / width))
    rows = rows.withColumn("_b", F.explode(F.array("_b", F.col("_b") + 1)))
    return rows.join(asked.select("symbol", "_b", "regime").distinct(), ["symbol", "_b"]), asked.toDF(*[f"{c}_" for c in asked.columns])


def cluster_volatility(panel: DataFrame, assignments: DataFrame, lookback_days: int = 252, horizon: int = 10, model: str = "ewma", decay: float = 0.94) -> DataFrame:
    """(date, symbol, vol_forecast, regime): per assignment date and regime, the volatility of the members'
    common factor (a lone member's own returns) over the lookback; every member has it, those without returns
    too. A group without any known return has no rows. -1 is a regime like any other."""
    members = assignments.select(F.col("date").alias("on"), "symbol", F.col("regime").cast("int").alias("regime"))
    rows, spread = lookback_blocks(panel, members, lookback_days)
    forecast, span = {"ewma": ewma_of, "garch": garch_of}[model], np.timedelta64(lookback_days, "D")

    def factors(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            rows = rows.sort_values(["symbol", "date", "log_return"]).drop_duplicates(["symbol", "date"])
            dates, symbols = np.unique(rows["date"].to_numpy()), np.unique(rows["symbol"].to_numpy())
            at = np.searchsorted(dates, rows["date"].to_numpy()), np.searchsorted(symbols, rows["symbol"].to_numpy())
            returns, there = np.full((len(dates), len(symbols)), np.nan), np.zeros((len(dates), len(symbols)), bool)
            returns[at], there[at] = rows["log_return"].to_numpy(float), True
            for on, group in asked.groupby("on_"):
                now = np.datetime64(on)
                low, high = np.searchsorted(dates, now - span, "left"), np.searchsorted(dates, now, "right")
                mine = np.isin(symbols, group["symbol_"].to_numpy())
                wide = returns[low:high, mine][there[low:high, mine].any(1)]
                wide = np.nan_to_num(wide[:, ~np.isnan(wide).all(0)], nan=0.0)
                if wide.size:
                    out.append((on, principal_axes(wide, 1)[:, 0] if wide.shape[1] > 1 else wide[:, 0]))
        return pd.DataFrame({"on": pd.Series([on for on, _ in out], dtype="datetime64[ns]"), "regime": np.int32(asked["regime_"].iloc[0] if len(asked) else 0), "vol_forecast": [forecast(x, decay, horizon) for _, x in out]})

    found = rows.groupBy("_b", "regime").cogroup(spread.groupBy("_b_", "regime_")).applyInPandas(factors, "on timestamp_ntz, regime int, vol_forecast double")
    members = assignments.select(F.col("date").alias("on"), "symbol", "regime")
    return members.join(found, ["on", "regime"]).select(F.col("on").alias("date"), "symbol", "vol_forecast", "regime")


def align_volatility(predictions: DataFrame, vol: DataFrame) -> DataFrame:
    """Predictions with the latest volatility and regime at or before each. A symbol whose first forecast is
    yet to come gets 0.01 and -1; one without any gets the rolling deviation of its target over 20 rows
    (5 at least), else 0.01."""
    joined = asof_backward(predictions, vol.select("date", "symbol", "vol_forecast", "regime"), ["vol_forecast", "regime"])
    covered = vol.select("symbol").distinct().withColumn("_covered", F.lit(True))
    own = rolling_std(F.col("target"), by_symbol(), 20, least=5)
    out = joined.withColumn("_own", own).join(covered, "symbol", "left")
    value = F.when(F.col("_covered"), F.col("vol_forecast")).otherwise(F.col("_own"))
    return out.withColumns({"vol_forecast": F.coalesce(value, F.lit(DEFAULT_VOL)), "regime": F.coalesce("regime", F.lit(UNKNOWN))}).drop("_own", "_covered")
