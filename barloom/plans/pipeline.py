"""The research pipeline from a panel to executed orders, and its artifacts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.segments import segment_of
from barloom.operators import execution_tables
from barloom.operators.features import INDICATORS, add_indicators, feature_columns, model_table, preprocess, robust_scale
from barloom.operators.forecast import walk_forward
from barloom.operators.regimes import attach_regime, discover_regimes, variation_of_information
from barloom.operators.sizing import build_orders, execution_filter, performance, with_order_id
from barloom.operators.volatility import align_volatility, cluster_volatility

SCALED = ("log_return", "realized_vol", "dollar_volume")


@dataclass(frozen=True)
class Market:
    """A market's settings."""

    return_lags: tuple[int, ...] = (1, 2, 3, 5, 10, 15)
    vol_window: int = 30
    indicators: bool = True
    rebalance_days: int = 7
    lookback_days: int = 126
    pca: int = 4
    ica: int = 4
    min_cluster_size: int = 6
    manifold: int = field(default=2, kw_only=True)
    vol_lookback: int = 252
    vol_horizon: int = 10
    vol_model: str = "ewma"
    vol_decay: float = 0.94
    train_min: int = 252
    test_step: int = 5
    model: str = "gbt"
    z_window: int = 60
    vol_gate: float = 0.75
    target_risk: float = 0.5
    max_position: float = 0.08
    max_shortfall_bps: float = 20.0


# The shipped markets.
MARKETS = {
    "stocks": Market(),
    "forex": Market((1, 2, 3, 5, 8), 20, True, 5, 90, 4, 4, 5, 180, 7, "ewma", 0.96, 220, 5, "gbt", 50, 0.70, 0.45, 0.06, 15.0),
    "crypto": Market((1, 2, 3, 5, 8), 20, True, 3, 90, 5, 5, 6, 180, 7, "ewma", 0.97, 220, 3, "gbt", 50, 0.65, 0.35, 0.05, 25.0),
    "intl_stocks": Market((1, 2, 3, 5, 7, 14), 30, True, 7, 126, 4, 4, 8, 252, 10, "ewma", 0.95, 252, 5, "gbt", 60, 0.72, 0.40, 0.06, 18.0),
    "smoke": Market((1, 2, 5), 15, False, 10, 40, 2, 2, 2, 80, 5, "ewma", 0.94, 60, 5, "gbt", 20, 0.85, 1.0, 0.20, 35.0),
}


@dataclass
class Run:
    """Tables of one run; every one is lazy. config_hash names the settings."""

    processed: DataFrame
    regimes: DataFrame
    vi_scores: DataFrame
    predictions: DataFrame
    vol_forecasts: DataFrame
    orders: DataFrame
    executed: DataFrame
    config_hash: str = field(default="")

    def metrics(self) -> DataFrame:
        """One row of nested figures: mean VI, approval rate, performance before and after execution."""
        before = self.orders.transform(performance).select(F.struct("*").alias("pre_exec"))
        after = performance(self.executed, "executed_pnl").select(F.struct("*").alias("post_exec"))
        rate = self.executed.agg(F.avg(F.col("approve").cast("double")).alias("approval_rate"))
        return self.vi_scores.agg(F.avg("vi").alias("avg_vi")).crossJoin(rate).crossJoin(before).crossJoin(after)


def config_hash(config: Market) -> str:
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()


def run_pipeline(panel: DataFrame, config: Market = Market(), variant: str = "rust") -> Run:
    base = preprocess(panel, config.vol_window)
    segment = segment_of(panel)
    base = robust_scale(add_indicators(base, config.indicators, segment=segment), [*SCALED, *(INDICATORS if config.indicators else ())])
    # Read again by each of the five steps below.
    base = base.persist()
    scaled = base.select("date", "symbol", *[F.col(f"{c}_scaled").alias(c) for c in SCALED]).na.drop()
    regimes = discover_regimes(scaled, config.rebalance_days, config.lookback_days, config.pca, config.ica, config.min_cluster_size, config.manifold).persist()
    with_regime = attach_regime(base, regimes, segment)
    extra = tuple(feature_columns(base, list(INDICATORS))) if config.indicators else ()
    rows = model_table(with_regime, list(config.return_lags), (*extra, "regime"))
    features = [c for c in rows.columns if c not in ("date", "symbol", "next_return")]
    predictions = walk_forward(rows, features, config.train_min, config.test_step, config.model).persist()
    vol = cluster_volatility(base, regimes, config.vol_lookback, config.vol_horizon, config.vol_model, config.vol_decay)
    orders = build_orders(align_volatility(predictions, vol), None, config.z_window, config.vol_gate, config.target_risk, config.max_position)
    executed = with_order_id(execution_filter(orders, config.max_shortfall_bps, variant))
    return Run(base, regimes, variation_of_information(regimes), predictions, vol, orders, executed, config_hash(config))


def export(run: Run, path: str, fmt: str = "parquet") -> None:
    """The run's tables under a folder, and its metrics as one JSON row."""
    for name in ("processed", "regimes", "vi_scores", "predictions", "vol_forecasts", "orders", "executed"):
        writer = getattr(run, name).write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{name}")
    run.metrics().write.mode("overwrite").json(f"{path}/metrics")
    with_text = execution_tables.report(run.executed, run.metrics())
    with_text.coalesce(1).write.mode("overwrite").text(f"{path}/report")
