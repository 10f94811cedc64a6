"""Returns, volatility, technical indicators, robust scaling and the model table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import by_symbol, clip, ewm_mean, exact_quantiles, linear_fill, rolling_std, safe_log, true_range
from barloom.functions.segments import SEG, Ewm, with_ewm, with_previous

INDICATORS = ("rsi_14", "atr_14", "macd_line", "macd_signal", "macd_hist")
PRICES = ["open", "high", "low", "close", "volume"]


def preprocess(panel: DataFrame, vol_window: int, fill: bool = True) -> DataFrame:
    """log_close, log_return, realized_vol, dollar_volume and next_return; one shuffle by symbol."""
    w = by_symbol()
    df = linear_fill(panel, [c for c in PRICES if c in panel.columns]) if fill else panel
    df = df.withColumn("log_close", safe_log(F.col("close")))
    df = df.withColumn("log_return", F.col("log_close") - F.lag("log_close").over(w))
    return df.withColumns({"realized_vol": rolling_std(F.col("log_return"), w, vol_window), "dollar_volume": F.col("close") * F.col("volume"), "next_return": F.lead("log_return").over(w)})


def _previous(df: DataFrame, columns: dict[str, str], segment: Column | None) -> DataFrame:
    if segment is None:
        return df.withColumns({new: F.lag(old).over(by_symbol()) for new, old in columns.items()})
    return with_previous(df.withColumn(SEG, segment), columns).drop(SEG)


def _means(df: DataFrame, means: list[Ewm], segment: Column | None) -> DataFrame:
    if segment is not None:
        return with_ewm(df.withColumn(SEG, segment), means).drop(SEG)
    for m in means:
        df = ewm_mean(df, m.value, m.alpha, m.out, least=m.least)
    return df


def rsi(df: DataFrame, period: int = 14, segment: Column | None = None) -> DataFrame:
    """With a segment (segments.segment_of), here and below, a long series is scanned by many tasks."""
    df = _previous(df, {"_d": "close"}, segment).withColumn("_d", F.col("close") - F.col("_d"))
    df = df.withColumns({"_up": clip(F.col("_d"), low=0.0), "_down": clip(-F.col("_d"), low=0.0)})
    df = _means(df, [Ewm(side, 1 / period, f"_mean{side}", period) for side in ("_up", "_down")], segment)
    value = 100 - 100 / (1 + F.col("_mean_up") / (F.col("_mean_down") + 1e-12))
    return df.withColumn(f"rsi_{period}", value).drop("_d", "_up", "_down", "_mean_up", "_mean_down")


def atr(df: DataFrame, period: int = 14, segment: Column | None = None) -> DataFrame:
    df = _previous(df, {"_tr": "close"}, segment)
    df = df.withColumn("_tr", true_range(F.col("high"), F.col("low"), F.col("_tr")))
    return _means(df, [Ewm("_tr", 1 / period, f"atr_{period}", period)], segment).drop("_tr")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, segment: Column | None = None) -> DataFrame:
    df = _means(df, [Ewm("close", 2 / (fast + 1), "_fast"), Ewm("close", 2 / (slow + 1), "_slow")], segment)
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow"))
    df = _means(df, [Ewm("macd_line", 2 / (signal + 1), "macd_signal")], segment)
    return df.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")).drop("_fast", "_slow")


def add_indicators(df: DataFrame, enabled: bool = True, columns: tuple[str, ...] = INDICATORS, source: str = "native", segment: Column | None = None) -> DataFrame:
    """Any source other than the native one falls back to it; one MACD column asks for all three."""
    if not enabled:
        return df
    if "rsi_14" in columns:
        df = rsi(df, segment=segment)
    if "atr_14" in columns:
        df = atr(df, segment=segment)
    if any(c.startswith("macd") for c in columns):
        df = macd(df, segment=segment)
    return df


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range over all rows; a range that is not finite or tiny counts as 1.
    The statistics are one row, so the join below is a one-row broadcast."""
    stats = exact_quantiles(df, columns, (0.25, 0.5, 0.75), "_q")

    def scaled(c: str) -> Column:
        q = F.col(f"_q_{c}")
        spread = q[2] - q[0]
        return (F.col(c) - q[1]) / F.when(spread >= 1e-9, spread).otherwise(1.0)

    return df.crossJoin(F.broadcast(stats)).withColumns({f"{c}_scaled": scaled(c) for c in columns}).drop(*[f"_q_{c}" for c in columns])


def feature_columns(df: DataFrame, indicators: list[str], use_scaled: bool = True) -> list[str]:
    """The scaled form of an indicator where there is one, else the raw one if it has a finite value."""
    raw = [c for c in indicators if c in df.columns and not (use_scaled and f"{c}_scaled" in df.columns)]
    alive = df.agg(*[F.max(F.col(c).isNotNull() & ~F.isnan(F.col(c))).alias(c) for c in raw]).first().asDict() if raw else {}
    return [f"{c}_scaled" if use_scaled and f"{c}_scaled" in df.columns else c for c in indicators if f"{c}_scaled" in df.columns or alive.get(c)]


def model_table(df: DataFrame, lags: list[int], extra: tuple[str, ...] = ()) -> DataFrame:
    """Lagged returns, realised volatility, dollar volume and further features, rows with a NULL left out."""
    w = by_symbol()
    features = [f"ret_lag_{k}" for k in lags] + ["realized_vol", "dollar_volume", *extra]
    df = df.withColumns({f"ret_lag_{k}": F.lag("log_return", k).over(w) for k in lags})
    return df.select("date", "symbol", *features, "next_return").na.drop()
