"""Order sizing, execution filter and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import by_symbol, clip, cross_section, rolling_std, rolling_zscore

BPS = 10000.0


def build_orders(predictions: DataFrame, vol: DataFrame | None, z_window: int = 60, gate: float = 0.75, target_risk: float = 0.5, cap: float = 0.08) -> DataFrame:
    """Signal z-score, volatility gate, inverse-volatility weight, gross normalisation, cap, edge and PnL.
    Two shuffles: by symbol, then by date. vol None: the predictions carry vol_forecast."""
    rows = predictions if vol is None else predictions.join(vol.select("date", "symbol", "vol_forecast", "regime"), ["date", "symbol"], "left")
    w, wd = by_symbol(), cross_section()
    own = F.coalesce(rolling_std(F.col("target"), w, 20, least=5), F.lit(0.01))
    rows = rows.withColumns({"vol_forecast": F.coalesce("vol_forecast", own), "signal_z": rolling_zscore(F.col("prediction"), w, z_window)})
    rows = rows.withColumn("date_vol_gate", F.percentile("vol_forecast", gate).over(wd))
    rows = rows.withColumn("trade_allowed", F.coalesce(F.col("vol_forecast") <= F.col("date_vol_gate"), F.lit(False)))
    rows = rows.withColumn("raw_weight", F.when(F.col("trade_allowed"), F.col("signal_z") / (F.abs("vol_forecast") + 1e-6)).otherwise(0.0))
    gross = F.sum(F.abs("raw_weight")).over(wd)
    rows = rows.withColumn("position", clip(F.when(gross > 0, F.col("raw_weight") / gross * target_risk).otherwise(0.0), -cap, cap))
    return rows.withColumns({"expected_edge_bps": F.col("prediction") * BPS, "realized_pnl": F.col("position") * F.col("target")})


def shortfall_bps(size: Column, vol: Column, pofi: Column, side: Column, variant: str = "rust") -> Column:
    """Predicted execution shortfall; only the `rust` variant charges buys 5 % more."""
    cost = 4.0 + 120.0 * F.abs(size) * F.greatest(vol, F.lit(1e-4)) + 16.0 * F.abs(pofi)
    return cost * F.when(side == "BUY", 1.05).otherwise(1.0) if variant == "rust" else cost


def execution_filter(orders: DataFrame, cap_bps: float = 20.0, variant: str = "rust") -> DataFrame:
    """Decides every order: approved if the predicted shortfall exceeds neither the expected edge (0 at
    least) nor the cap. A missing volatility is never approved."""
    rows = orders.withColumns({"side": F.when(F.col("position") >= 0, "BUY").otherwise("SELL"), "size": F.abs("position"), "pofi": F.sum("position").over(cross_section())})
    edge, vol = clip(F.col("expected_edge_bps"), low=0.0), clip(F.col("vol_forecast"), low=1e-6)
    rows = rows.withColumn("predicted_shortfall_bps", F.when(vol.isNotNull(), shortfall_bps(F.col("size"), vol, F.col("pofi"), F.col("side"), variant)))
    over_edge, over_cap = F.col("predicted_shortfall_bps") > edge, F.col("predicted_shortfall_bps") > cap_bps
    approve = F.coalesce(~over_edge & ~over_cap, F.lit(False))
    if variant == "rust":
        reason = F.when(approve, "ok").when(over_edge, "predicted_shortfall_exceeds_expected_edge").otherwise("predicted_shortfall_exceeds_max_shortfall")
    else:
        reason = F.when(approve, "ok").otherwise("shortfall_exceeds_edge")
    rows = rows.withColumns({"approve": approve, "reason": reason})
    rows = rows.withColumn("adjusted_size", F.when(F.col("approve"), F.col("size")).otherwise(0.0))
    rows = rows.withColumn("exec_position", F.when(F.col("side") == "BUY", F.col("adjusted_size")).otherwise(-F.col("adjusted_size")))
    return rows.withColumn("executed_pnl", F.col("exec_position") * F.col("target"))


def with_order_id(orders: DataFrame) -> DataFrame:
    """order_id: the place in (date, symbol) order from 0. Dates are counted first (one row a date), so
    ranks within a date plus the orders of earlier dates give the number without a global sort."""
    per_date = orders.groupBy("date").agg(F.count("*").alias("_n"))
    before = per_date.select("date", F.coalesce(F.sum("_n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = orders.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy("symbol")) - 1)
    return ranked.join(before, "date").withColumn("order_id", F.col("_before") + F.col("_r")).drop("_before", "_r")


def daily(orders: DataFrame, value: str = "realized_pnl") -> DataFrame:
    return orders.groupBy("date").agg(F.sum(value).alias("ret"))


def performance(orders: DataFrame, value: str = "realized_pnl") -> DataFrame:
    """One row: mean and deviation of daily returns, Sharpe ratio, compound return; zeros without rows."""
    d = daily(orders, value)
    mean, deviation = F.coalesce(F.avg("ret"), F.lit(0.0)), F.coalesce(F.stddev_samp("ret"), F.lit(0.0))
    return d.agg(mean.alias("mean_daily_return"), deviation.alias("vol_daily_return"), F.coalesce(F.avg("ret") / (F.stddev_samp("ret") + 1e-12) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"), F.coalesce(F.product(1 + F.col("ret")) - 1, F.lit(0.0)).alias("cum_return"))


def equity_curve(orders: DataFrame, value: str = "realized_pnl") -> DataFrame:
    """Compounded return by date; one row a date, so the running product is over dates only."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily(orders, value).select("date", "ret", F.product(1 + F.col("ret")).over(w).alias("equity"))
