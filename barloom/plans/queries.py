"""Registered queries over the test tables and the SQL that each must match.

Numbers that two engines may sum in different orders are compared at six decimals by floor(x * 1e6 + 0.5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import by_symbol, cross_section, linear_fill, rolling_std, rolling_zscore
from barloom.functions.segments import wall_seconds
from barloom.operators import features, joins, regimes, services, sizing, volatility
from barloom.operators.forecast import walk_forward
from barloom.plans.pipeline import MARKETS, run_pipeline
from barloom.streaming import live
from barloom.streaming.order_life import order_life
from barloom.sources import artifacts, brokers, html_tables
from barloom.sources.panel import generated_ohlcv, hourly_bars, read_ohlcv, table, user_days, weekly_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def f6(x: Column | str) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.5) / 1e6


def s6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 5e-1) / 1e6"


def rounded(df: DataFrame, keep: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, *[f6(c).alias(c) for c in numbers])


BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS date, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
FEATURES = (
    BARS
    + """, logs AS (SELECT *, ln(greatest(close, 1e-12)) AS log_close FROM bars),
rets AS (SELECT *, log_close - lag(log_close) OVER w AS log_return FROM logs WINDOW w AS (PARTITION BY symbol ORDER BY date)),
feats AS (SELECT *, CASE WHEN count(log_return) OVER r >= 5 THEN stddev_samp(log_return) OVER r END AS realized_vol,
  close * volume AS dollar_volume, lead(log_return) OVER w AS next_return FROM rets
  WINDOW w AS (PARTITION BY symbol ORDER BY date), r AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
)


def by_week() -> Column:
    """The segments of the scans below: a series' weeks lie in tasks of their own."""
    return F.floor(wall_seconds(F.col("date")) / (7 * 86400)).cast("long")


def bars_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.preprocess(hourly_bars(spark, sf_dir), 20, fill=False)


@registered(f"WITH {BARS} SELECT * FROM bars")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_bars(spark, sf_dir)


@registered(
    f"""SELECT p_brand AS symbol, date_trunc('week', l_shipdate) AS date, {s6("avg(l_extendedprice / l_quantity)")} AS close,
max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, {s6("sum(l_quantity)")} AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
)
def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = weekly_bars(spark, sf_dir)
    return df.withColumns({"close": f6("close"), "volume": f6("volume")})


@registered(f"WITH {FEATURES} SELECT symbol, date, {', '.join(f'{s6(c)} AS {c}' for c in ('log_close', 'log_return', 'realized_vol', 'dollar_volume', 'next_return'))} FROM feats")
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars_features(spark, sf_dir), ("symbol", "date"), ("log_close", "log_return", "realized_vol", "dollar_volume", "next_return"))


@registered(
    f"""WITH seen AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, max(value) AS close FROM events GROUP BY 1, 2),
spans AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM seen GROUP BY 1),
cal AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM spans),
j AS (SELECT cal.symbol, cal.date, close, row_number() OVER (PARTITION BY cal.symbol ORDER BY cal.date) AS i FROM cal LEFT JOIN seen ON cal.symbol = seen.symbol AND cal.date = seen.date),
k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(close IGNORE NULLS) OVER b AS pv,
 first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(close IGNORE NULLS) OVER a AS nv FROM j
 WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, CAST(date AS TIMESTAMP) AS date, {s6("CASE WHEN close IS NOT NULL THEN close WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END")} AS close FROM k"""
)
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linear_fill(user_days(spark, sf_dir).select("symbol", F.col("date").cast("timestamp_ntz").alias("date"), "close"), ["close"]), ("symbol", "date"), ("close",))


@registered(
    f"""WITH {FEATURES}, m AS (SELECT symbol, date, lag(log_return, 1) OVER w AS ret_lag_1, lag(log_return, 2) OVER w AS ret_lag_2, lag(log_return, 5) OVER w AS ret_lag_5,
 realized_vol, dollar_volume, next_return FROM feats WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, {', '.join(f'{s6(c)} AS {c}' for c in ('ret_lag_1', 'ret_lag_2', 'ret_lag_5', 'realized_vol', 'dollar_volume', 'next_return'))} FROM m
WHERE ret_lag_1 IS NOT NULL AND ret_lag_2 IS NOT NULL AND ret_lag_5 IS NOT NULL AND realized_vol IS NOT NULL AND dollar_volume IS NOT NULL AND next_return IS NOT NULL"""
)
def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.model_table(bars_features(spark, sf_dir), [1, 2, 5])
    return rounded(df, ("symbol", "date"), ("ret_lag_1", "ret_lag_2", "ret_lag_5", "realized_vol", "dollar_volume", "next_return"))


@registered(
    f"""WITH {BARS}, q AS (SELECT quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.5) AS m, quantile_cont(close, 0.75) AS b,
 quantile_cont(volume, 0.25) AS va, quantile_cont(volume, 0.5) AS vm, quantile_cont(volume, 0.75) AS vb FROM bars)
SELECT symbol, date, {s6("(close - m) / CASE WHEN b - a >= 1e-9 THEN b - a ELSE 1.0 END")} AS close_scaled,
{s6("(volume - vm) / CASE WHEN vb - va >= 1e-9 THEN vb - va ELSE 1.0 END")} AS volume_scaled FROM bars, q"""
)
def robust_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.robust_scale(hourly_bars(spark, sf_dir), ["close", "volume"]), ("symbol", "date"), ("close_scaled", "volume_scaled"))


def ewm_sql(source: str, value: str, alpha: str, out: str, least: int = 0) -> str:
    """The recursion unrolled as a running sum; the value's leading NULLs carry no weight."""
    r = f"(1e0 - {alpha})"
    return f"""{out}_k AS (SELECT *, count({value}) OVER (PARTITION BY symbol ORDER BY date) AS {out}_n FROM {source}),
{out}_t AS (SELECT *, CASE WHEN {out}_n >= {max(least, 1)} THEN sum(CASE WHEN {value} IS NULL THEN 0e0 WHEN {out}_n = 1 THEN {value} ELSE {alpha} * {value} * power({r}, 1 - {out}_n) END)
 OVER (PARTITION BY symbol ORDER BY date) * power({r}, {out}_n - 1) END AS {out} FROM {out}_k)"""


@registered(
    f"""WITH {BARS}, d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM bars),
u AS (SELECT symbol, date, CASE WHEN d IS NOT NULL THEN greatest(d, 0e0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0e0) END AS down FROM d),
{ewm_sql("u", "up", "(1e0 / 14)", "gain", 14)}, {ewm_sql("gain_t", "down", "(1e0 / 14)", "loss", 14)}
SELECT symbol, date, {s6("100e0 - 100e0 / (1 + gain / (loss + 1e-12))")} AS rsi_14 FROM loss_t"""
)
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.rsi(hourly_bars(spark, sf_dir), segment=by_week()), ("symbol", "date"), ("rsi_14",))


@registered(
    f"""WITH {BARS}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars),
tr AS (SELECT symbol, date, greatest(abs(high - low), abs(high - pc), abs(low - pc)) AS tr FROM p), {ewm_sql("tr", "tr", "(1e0 / 14)", "atr", 14)}
SELECT symbol, date, {s6("atr")} AS atr_14 FROM atr_t"""
)
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.atr(hourly_bars(spark, sf_dir), segment=by_week()), ("symbol", "date"), ("atr_14",))


@registered(
    f"""WITH {BARS}, {ewm_sql("bars", "close", "(2e0 / 13)", "fast")}, {ewm_sql("fast_t", "close", "(2e0 / 27)", "slow")},
line AS (SELECT symbol, date, fast - slow AS macd_line FROM slow_t), {ewm_sql("line", "macd_line", "(2e0 / 10)", "sig")}
SELECT symbol, date, {s6("macd_line")} AS macd_line, {s6("sig")} AS macd_signal, {s6("macd_line - sig")} AS macd_hist FROM sig_t"""
)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.macd(hourly_bars(spark, sf_dir), segment=by_week()), ("symbol", "date"), ("macd_line", "macd_signal", "macd_hist"))


# A stand-in for regimes that SQL can express: on every 24th hour, whether a symbol traded above its day's mean.
STAND_IN = """days AS (SELECT DISTINCT date FROM bars), every AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM days) WHERE (n - 1) % 24 = 0),
reg AS (SELECT b.symbol, b.date, CAST(CASE WHEN b.volume > 2 THEN 1 ELSE 0 END AS INTEGER) AS regime FROM bars b JOIN every e ON b.date = e.date)"""


def stand_in_regimes(bars: DataFrame) -> DataFrame:
    every = joins.rebalance_dates(bars, 24).withColumnRenamed("rebalance_date", "date")
    return bars.join(every, "date").select("symbol", "date", F.when(F.col("volume") > 2, 1).otherwise(0).alias("regime"))


@registered(f"WITH {BARS}, {STAND_IN} SELECT b.symbol, b.date, b.close, CAST(coalesce(r.regime, -1) AS INTEGER) AS regime FROM bars b ASOF LEFT JOIN reg r ON b.symbol = r.symbol AND b.date >= r.date")
def asof_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly_bars(spark, sf_dir)
    return regimes.attach_regime(bars.select("symbol", "date", "close"), stand_in_regimes(bars), by_week())


@registered(
    f"""WITH {FEATURES}, {STAND_IN}, pred AS (SELECT symbol, date, next_return AS target FROM feats WHERE next_return IS NOT NULL),
vol AS (SELECT r.symbol, r.date, f.realized_vol AS vol_forecast, r.regime FROM reg r JOIN feats f ON r.symbol = f.symbol AND r.date = f.date WHERE f.realized_vol IS NOT NULL AND r.symbol <> 'click'),
own AS (SELECT *, CASE WHEN count(target) OVER w >= 5 THEN stddev_samp(target) OVER w END AS own FROM pred WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT o.symbol, o.date, {s6("coalesce(CASE WHEN o.symbol IN (SELECT symbol FROM vol) THEN v.vol_forecast ELSE own END, 0.01e0)")} AS vol_forecast, CAST(coalesce(v.regime, -1) AS INTEGER) AS regime
FROM own o ASOF LEFT JOIN vol v ON o.symbol = v.symbol AND o.date >= v.date"""
)
def asof_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars_features(spark, sf_dir)
    vol = stand_in_regimes(df).join(df.select("symbol", "date", F.col("realized_vol").alias("vol_forecast")), ["symbol", "date"]).where("vol_forecast is not null and symbol <> 'click'")
    predictions = df.where("next_return is not null").select("symbol", "date", F.col("next_return").alias("target"))
    return rounded(volatility.align_volatility(predictions, vol), ("symbol", "date", "regime"), ("vol_forecast",))


@registered(
    f"""WITH {FEATURES}, dates AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM feats)), reb AS (SELECT date AS d FROM dates WHERE (n - 1) % 48 = 0),
st AS (SELECT d AS rebalance_date, symbol, avg(log_return) AS mean_ret, stddev_samp(log_return) AS std_ret, avg(realized_vol) AS mean_vol, avg(dollar_volume) AS mean_dv
 FROM reb JOIN feats ON date <= d AND date >= d - INTERVAL 5 DAY GROUP BY 1, 2),
ok AS (SELECT *, count(*) OVER (PARTITION BY rebalance_date) AS n FROM st WHERE mean_ret IS NOT NULL AND std_ret IS NOT NULL AND mean_vol IS NOT NULL AND mean_dv IS NOT NULL)
SELECT rebalance_date, symbol, {', '.join(f'{s6(c)} AS {c}' for c in ('mean_ret', 'std_ret', 'mean_vol', 'mean_dv'))} FROM ok WHERE n >= 3"""
)
def lookback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regimes.lookback_stats(bars_features(spark, sf_dir), 5, 48, 3)
    return rounded(df, ("rebalance_date", "symbol"), ("mean_ret", "std_ret", "mean_vol", "mean_dv"))


@registered(
    f"""WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rank FROM (SELECT DISTINCT date FROM bars)),
f AS (SELECT CAST((rank - 100) / 50 AS INTEGER) AS fold, rank AS first_rank FROM d WHERE rank >= 100 AND (rank - 100) % 50 = 0 AND rank + 50 <= (SELECT max(rank) + 1 FROM d))
SELECT fold, rank >= first_rank AS is_test, count(*) AS n, min(date) AS first_date, max(date) AS last_date, max(close) AS top FROM bars JOIN d USING (date) JOIN f ON rank < first_rank + 50 GROUP BY 1, 2"""
)
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.fold_rows(hourly_bars(spark, sf_dir), 100, 50)
    return rows.groupBy("fold", "is_test").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("close").alias("top"))


VI = f"""ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM reg)),
c AS (SELECT n.date, ds.prev_date, n.regime AS x, o.regime AS y, count(*) AS n FROM reg n JOIN ds ON n.date = ds.date JOIN reg o ON o.date = ds.prev_date AND o.symbol = n.symbol GROUP BY 1, 2, 3, 4),
t AS (SELECT date, prev_date, x, y, n::DOUBLE / sum(n) OVER (PARTITION BY date) AS p, sum(n) OVER (PARTITION BY date) AS total FROM c),
hx AS (SELECT date, -sum(p * ln(p + 1e-12)) AS h FROM (SELECT date, x, sum(p) AS p FROM t GROUP BY 1, 2) GROUP BY 1),
hy AS (SELECT date, -sum(p * ln(p + 1e-12)) AS h FROM (SELECT date, y, sum(p) AS p FROM t GROUP BY 1, 2) GROUP BY 1),
ex AS (SELECT date, -sum(p * ln(p)) AS h FROM (SELECT date, x, sum(p) AS p FROM t GROUP BY 1, 2) GROUP BY 1),
ey AS (SELECT date, -sum(p * ln(p)) AS h FROM (SELECT date, y, sum(p) AS p FROM t GROUP BY 1, 2) GROUP BY 1),
exy AS (SELECT date, prev_date, CAST(max(total) AS INTEGER) AS n_overlap, -sum(p * ln(p)) AS h FROM t GROUP BY 1, 2),
vis AS (SELECT exy.date, prev_date, n_overlap, hx.h + hy.h - 2 * (ex.h + ey.h - exy.h) AS vi FROM exy JOIN hx USING (date) JOIN hy USING (date) JOIN ex USING (date) JOIN ey USING (date))"""


@registered(f"WITH {BARS}, {STAND_IN}, {VI} SELECT date, prev_date, n_overlap, {s6('vi')} AS vi FROM vis")
def variation_of_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regimes.variation_of_information(stand_in_regimes(hourly_bars(spark, sf_dir))), ("date", "prev_date", "n_overlap"), ("vi",))


@registered(
    f"""WITH {FEATURES}, k AS (SELECT symbol, log_return AS r, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS age FROM feats WHERE log_return IS NOT NULL)
SELECT symbol, {s6("sqrt((power(0.94e0, count(*)) * var_pop(r) + 0.06e0 * sum(power(0.94e0, age) * r * r)) * 10)")} AS vol_forecast FROM k GROUP BY symbol"""
)
def ewma_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volatility.ewma_vol(bars_features(spark, sf_dir), 0.94, 10), ("symbol",), ("vol_forecast",))


#: From predictions with a volatility (pv) to orders.
CHAIN = """,
z AS (SELECT *, coalesce(CASE WHEN count(prediction) OVER w >= 5 THEN (prediction - avg(prediction) OVER w) / (stddev_samp(prediction) OVER w + 1e-9) END, 0e0) AS signal_z FROM pv
 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, quantile_cont(vol_forecast, 0.75) OVER (PARTITION BY date) AS date_vol_gate FROM z),
a AS (SELECT *, vol_forecast <= date_vol_gate AS trade_allowed, CASE WHEN vol_forecast <= date_vol_gate THEN signal_z / (abs(vol_forecast) + 1e-6) ELSE 0e0 END AS raw_weight FROM g),
s AS (SELECT *, sum(abs(raw_weight)) OVER (PARTITION BY date) AS gross FROM a),
o AS (SELECT *, greatest(-0.08e0, least(0.08e0, CASE WHEN gross > 0 THEN raw_weight / gross * 0.5e0 ELSE 0e0 END)) AS position FROM s),
ord AS (SELECT *, prediction * 10000e0 AS expected_edge_bps, position * target AS realized_pnl FROM o)"""
PREDICTED = (
    FEATURES
    + """, pred AS (SELECT symbol, date, next_return AS target, avg(log_return) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS prediction, realized_vol AS vol_forecast FROM feats),
pv AS (SELECT * FROM pred WHERE target IS NOT NULL AND prediction IS NOT NULL AND vol_forecast IS NOT NULL)"""
    + CHAIN
)


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_symbol().rowsBetween(-2, 0)
    df = bars_features(spark, sf_dir).select("symbol", "date", F.col("next_return").alias("target"), F.avg("log_return").over(w).alias("prediction"), F.col("realized_vol").alias("vol_forecast"))
    return sizing.build_orders(df.na.drop(), None, z_window=20)


@registered(f"WITH {PREDICTED} SELECT symbol, date, trade_allowed, {', '.join(f'{s6(c)} AS {c}' for c in ('signal_z', 'date_vol_gate', 'raw_weight', 'position', 'expected_edge_bps', 'realized_pnl'))} FROM ord")
def sized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sized(spark, sf_dir), ("symbol", "date", "trade_allowed"), ("signal_z", "date_vol_gate", "raw_weight", "position", "expected_edge_bps", "realized_pnl"))


def executed_sql(variant: str) -> str:
    buy = "CASE WHEN side = 'BUY' THEN 1.05e0 ELSE 1e0 END" if variant == "rust" else "1e0"
    reason = (
        "CASE WHEN approve THEN 'ok' WHEN cost > edge THEN 'predicted_shortfall_exceeds_expected_edge' ELSE 'predicted_shortfall_exceeds_max_shortfall' END"
        if variant == "rust"
        else "CASE WHEN approve THEN 'ok' ELSE 'shortfall_exceeds_edge' END"
    )
    return f"""{PREDICTED}, e1 AS (SELECT *, CASE WHEN position >= 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(position) AS size, sum(position) OVER (PARTITION BY date) AS pofi, greatest(expected_edge_bps, 0e0) AS edge FROM ord),
e2 AS (SELECT *, (4e0 + 120e0 * size * greatest(vol_forecast, 1e-4) + 16e0 * abs(pofi)) * {buy} AS cost FROM e1),
e3 AS (SELECT *, cost <= edge AND cost <= 20e0 AS approve FROM e2),
ex AS (SELECT *, {reason} AS reason, CASE WHEN approve THEN size ELSE 0e0 END AS adjusted_size, CASE WHEN NOT approve THEN 0e0 WHEN side = 'BUY' THEN size ELSE -size END AS exec_position FROM e3)"""


def executed_query(variant: str) -> str:
    return f"""WITH {executed_sql(variant)} SELECT row_number() OVER (ORDER BY date, symbol) - 1 AS order_id, symbol, date, side, approve, reason, {s6("cost")} AS predicted_shortfall_bps,
{s6("adjusted_size")} AS adjusted_size, {s6("exec_position")} AS exec_position, {s6("exec_position * target")} AS executed_pnl FROM ex"""


def executed(spark: SparkSession, sf_dir: str, variant: str = "rust") -> DataFrame:
    return sizing.execution_filter(sized(spark, sf_dir), 20.0, variant)


def executed_rows(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    df = sizing.with_order_id(executed(spark, sf_dir, variant))
    return rounded(df, ("order_id", "symbol", "date", "side", "approve", "reason"), ("predicted_shortfall_bps", "adjusted_size", "exec_position", "executed_pnl"))


@registered(executed_query("rust"))
def executed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executed_rows(spark, sf_dir, "rust")


@registered(executed_query("python"))
def executed_orders_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executed_rows(spark, sf_dir, "python")


@registered(
    f"""WITH {PREDICTED}, d AS (SELECT date, sum(realized_pnl) AS ret FROM ord GROUP BY 1)
SELECT {s6("avg(ret)")} AS mean_daily_return, {s6("stddev_samp(ret)")} AS vol_daily_return, {s6("avg(ret) / (stddev_samp(ret) + 1e-12) * sqrt(252e0)")} AS sharpe, {s6("product(1 + ret) - 1")} AS cum_return FROM d"""
)
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sizing.performance(sized(spark, sf_dir)), (), ("mean_daily_return", "vol_daily_return", "sharpe", "cum_return"))


@registered(
    f"WITH {PREDICTED}, d AS (SELECT date, sum(realized_pnl) AS ret FROM ord GROUP BY 1) SELECT date, {s6('ret')} AS ret, {s6('product(1 + ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS equity FROM d"
)
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sizing.equity_curve(sized(spark, sf_dir)), ("date",), ("ret", "equity"))


@registered(f"WITH {executed_sql('rust')}, t AS (SELECT symbol, sum(exec_position * target) AS net_pnl FROM ex GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT symbol, {s6('net_pnl')} AS net_pnl FROM t")
def top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(services.top_symbols(executed(spark, sf_dir), 3), ("symbol",), ("net_pnl",))


@registered(
    f"""WITH {PREDICTED}, c AS (SELECT (SELECT median(abs(target)) * 10000e0 FROM pv) AS edge, (SELECT median(vol_forecast) FROM pv) AS vol),
k AS (SELECT edge, 1e0 / (1 + 1e0) AS stability, greatest(0e0, 1 - least(vol * 5000e0 / 20e0, 1e0)) AS feas FROM c),
r AS (SELECT * FROM (VALUES ('stocks_regime_momentum', 'momentum', 'balanced', 1e0), ('stocks_mean_reversion', 'mean_reversion', 'conservative', 0.85e0)) v(strategy_id, family, risk_profile, mult))
SELECT strategy_id, family, risk_profile, {s6("(least(edge / 20e0, 1e0) * 0.4e0 + stability * 0.2e0 + feas * 0.3e0) * mult")} AS score, {s6("greatest(0e0, least((least(edge / 20e0, 1e0) * 0.4e0 + stability * 0.2e0 + feas * 0.3e0) * mult, 1e0))")} AS confidence,
{s6("edge * mult * feas")} AS expected_edge_bps, {s6("stability")} AS stability, {s6("feas")} AS feasibility, 'stocks' AS market,
concat_ws(',', printf('edge_bps=%.2f', edge), printf('stability=%.3f', stability), printf('execution_feasibility=%.3f', feas), 'risk_profile=' || risk_profile) AS reasons FROM r, k"""
)
def rank_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sized(spark, sf_dir)
    none = spark.createDataFrame([], "vi double")
    ranked = services.rank_strategies(spark, "Stocks ", df, df, none).withColumn("reasons", F.array_join("reasons", ","))
    return rounded(ranked, ("strategy_id", "market", "family", "risk_profile", "reasons"), ("score", "confidence", "expected_edge_bps", "stability", "feasibility"))


@registered(
    f"""WITH {executed_sql('rust')}, w AS (SELECT min(p) AS worst FROM (SELECT CAST(date AS DATE) AS d, sum(exec_position * target) AS p FROM ex GROUP BY 1)),
m AS (SELECT count(*) AS n, avg(approve::DOUBLE) AS rate, max(cost) AS top, max(abs(exec_position)) AS expo FROM ex)
SELECT CASE WHEN n = 0 OR rate < 0.6 OR top > 20 OR worst < -0.03 OR expo > 0.25 THEN 'NO_GO' ELSE 'GO' END AS decision,
concat_ws(',', CASE WHEN n = 0 THEN 'no_orders' END, CASE WHEN rate < 0.6 THEN 'approval_rate_below_threshold' END, CASE WHEN top > 20 THEN 'shortfall_limit_exceeded' END,
 CASE WHEN worst < -0.03 THEN 'max_daily_loss_exceeded' END, CASE WHEN expo > 0.25 THEN 'symbol_exposure_exceeded' END) AS breached,
{s6("rate")} AS approval_rate, {s6("top")} AS max_shortfall_bps, {s6("worst")} AS worst_day, {s6("expo")} AS max_exposure FROM m, w"""
)
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = executed(spark, sf_dir)
    out = services.review(df, df).withColumn("breached", F.array_join("breached_checks", ","))
    return rounded(out, ("decision", "breached"), ("approval_rate", "max_shortfall_bps", "worst_day", "max_exposure"))


@registered(
    f"""WITH {executed_sql('rust')}, pos AS (SELECT event_type AS symbol, sum(value) / 1e4 AS u, sum(value) AS x FROM events GROUP BY 1),
t AS (SELECT sum(exec_position * target) AS realized, sum(abs(exec_position)) * 1e-4 AS fees, coalesce(sum(CASE WHEN CAST(date AS DATE) = DATE '2024-01-15' THEN exec_position * target END), 0e0) AS daily FROM ex),
u AS (SELECT sum(u) AS u FROM pos), sy AS (SELECT symbol, sum(exec_position * target) AS v FROM ex GROUP BY 1)
SELECT {s6("realized")} AS realized_pnl, {s6("u")} AS unrealized_pnl, {s6("daily")} AS daily_pnl, {s6("fees")} AS fees, {s6("realized + u - fees")} AS net_pnl,
(SELECT string_agg(symbol, ',' ORDER BY symbol) FROM sy) AS symbols, (SELECT {s6("sum(x)")} FROM pos) AS exposure FROM t, u"""
)
def pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg((F.sum("value") / 1e4).alias("unrealized_pnl"), F.sum("value").alias("exposure"))
    out = services.pnl_snapshot(executed(spark, sf_dir), positions, "2024-01-15")
    total = F.aggregate(F.map_values("exposure_by_symbol"), F.lit(0.0), lambda a, v: a + v)
    out = out.withColumns({"symbols": F.array_join(F.array_sort(F.map_keys("by_symbol")), ","), "exposure": total})
    return rounded(out, ("symbols",), ("realized_pnl", "unrealized_pnl", "daily_pnl", "fees", "net_pnl", "exposure"))


@registered(
    """SELECT event_id, concat_ws(',', CASE WHEN value / 1000 > 0.25 THEN 'symbol_exposure_limit' END, CASE WHEN value / 400 > 1 THEN 'portfolio_exposure_limit' END,
CASE WHEN -value / 10000 < -0.03 THEN 'daily_loss_limit' END) AS breaches FROM events"""
)
def validate_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(services.intent_breaches(v / 1000, v / 400, -v / 10000), ",").alias("breaches"))


@registered(
    """WITH RECURSIVE m AS (SELECT user_id AS order_id, event_id, (event_id * 5) % 7 AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT order_id, event_id, place, i, CAST(-1 AS BIGINT) AS before, place = 0 AS legal FROM m WHERE i = 1
 UNION ALL SELECT m.order_id, m.event_id, m.place, m.i, p.now, m.place = p.now + 1 FROM m JOIN (SELECT order_id, i, CASE WHEN NOT legal THEN before WHEN place = 6 THEN -1 ELSE place END AS now FROM r) p ON m.order_id = p.order_id AND m.i = p.i + 1),
s AS (SELECT ['DRAFT', 'CALCULATING', 'READY_FOR_REVIEW', 'COUNTDOWN', 'CONFIRMED', 'SUBMITTED', 'ACKED'] AS names)
SELECT order_id, event_id, names[place + 1] AS state, CASE WHEN before >= 0 THEN names[before + 1] END AS previous, legal FROM r, s"""
)
def state_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in services.STATES]), ((F.col("event_id") * 5) % 7 + 1).cast("int"))
    moves = table(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), "event_id", "ts", state.alias("state"))
    return services.state_audit(moves).drop("ts")


@registered(f"WITH {FEATURES} SELECT date, " + ", ".join(f"{s6(f'''coalesce(max(CASE WHEN symbol = '{s}' THEN log_return END), 0e0)''')} AS {s}" for s in ("click", "purchase", "view")) + " FROM feats GROUP BY date")
def pivot_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bars_features(spark, sf_dir).groupBy("date").pivot("symbol", ["click", "purchase", "view"]).agg(F.first("log_return", ignorenulls=True))
    return rounded(wide.na.fill(0.0), ("date",), ("click", "purchase", "view"))


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(members, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@registered("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(ordered, "c_custkey", "left_anti")


@registered("SELECT DISTINCT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def common_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_returnflag")
    return lines.where("l_returnflag = 'R'").select("partkey").intersect(lines.where("l_returnflag = 'A'").select("partkey"))


@registered("SELECT DISTINCT event_type AS run_id FROM events UNION SELECT 'run_test_001'")
def terminated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.terminate(table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id")), "run_test_001")


@registered(f"SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, {s6('sin(x / 10e0) * cos(y / 10e0)')} AS z FROM range(90, 111) a(x), range(1, 31) b(y)")
def mock_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(services.mock_surface(spark), ("x", "y"), ("z",))


@registered(
    """WITH g AS (SELECT * FROM (VALUES (1, 'delta'), (2, 'gamma'), (3, 'theta'), (4, 'vega'), (5, 'rho')) v(i, g))
SELECT a.g AS x, b.g AS y, c.g AS z FROM g a JOIN g b ON a.i < b.i JOIN g c ON b.i < c.i"""
)
def greek_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.greek_combinations(spark).drop("place")


@registered(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a, generate_subscripts(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is'), 1) - 1 AS position FROM pages)
SELECT page_id, CAST(position AS INTEGER) AS position, regexp_extract(a, 'href="([^"]*)"', 1, 'is') AS url, trim(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')) AS headline FROM l"""
)
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.headlines(table(spark, sf_dir, "pages"))


@registered(
    """SELECT c_custkey, o_orderkey, sum(l_quantity) AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def store_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's key path parent, child, grandchild, on tables of that shape."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey")
    return rows.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "o_orderkey", "quantity")


@registered(
    f"""WITH {FEATURES} SELECT symbol, date, {s6("coalesce(CASE WHEN count(close) OVER w >= 5 THEN (close - avg(close) OVER w) / (stddev_samp(close) OVER w + 1e-9) END, 0e0)")} AS z,
{s6("sum(close) OVER (PARTITION BY date)")} AS total, {s6("quantile_cont(close, 0.75) OVER (PARTITION BY date)")} AS gate FROM feats WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
)
def cross_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, wd = by_symbol(), cross_section()
    df = hourly_bars(spark, sf_dir).select("symbol", "date", rolling_zscore(F.col("close"), w, 20).alias("z"), "close")
    return rounded(df.withColumns({"total": F.sum("close").over(wd), "gate": F.percentile("close", 0.75).over(wd)}), ("symbol", "date"), ("z", "total", "gate"))


@registered(
    """SELECT * FROM (VALUES ('tradingview', 'webhook', true, false, false), ('fidelity_active_trader', 'ticket', true, true, true), ('robinhood_crypto', 'rest', true, true, true),
('gemini', 'rest', true, true, true), ('forex_com', 'rest', true, true, true)) v(adapter, route, submit, cancel, "close")"""
)
def broker_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.capabilities(spark)


@registered(
    """SELECT o_orderkey, adapter, CASE WHEN adapter = 'gemini' THEN to_json(struct_pack(symbol := symbol, side := side, amount := quantity, order_type := 'exchange market'))
ELSE to_json(struct_pack(symbol := symbol, side := side, quantity := quantity, order_type := 'market')) END::VARCHAR AS payload
FROM (SELECT o_orderkey, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_totalprice / 1000 AS quantity FROM orders),
 (VALUES ('tradingview'), ('fidelity_active_trader'), ('robinhood_crypto'), ('gemini'), ('forex_com')) b(adapter)"""
)
def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dry-run payload of every order for each broker."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("o_totalprice") / 1000).alias("quantity"))
    rows = orders.crossJoin(F.broadcast(services.capabilities(spark).select("adapter")))
    return rows.select("o_orderkey", "adapter", services.order_payload(F.col("adapter"), F.col("symbol"), F.col("side"), F.col("quantity"), F.lit("market"), F.lit(None).cast("double")).alias("payload"))


@registered(
    """SELECT e.event_id, e.event_type AS adapter_kind, b.route, coalesce(b.submit, false) AS accepted, coalesce(b.cancel, false) AS cancellable
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'tradingview' ELSE 'nobody' END AS adapter FROM events) e
LEFT JOIN (VALUES ('tradingview', 'webhook', true, false), ('gemini', 'rest', true, true)) b(adapter, route, submit, cancel) ON e.adapter = b.adapter"""
)
def routed_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("event_id") % 3
    intents = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("adapter_kind"), F.when(third == 0, "gemini").when(third == 1, "tradingview").otherwise("nobody").alias("adapter"))
    return services.routed(intents, services.capabilities(spark)).drop("adapter")


@registered(
    """SELECT event_type AS adapter, 1 AS step, 'cancel' AS action, CAST(event_id AS VARCHAR) AS target, CAST(NULL AS DOUBLE) AS quantity FROM events WHERE event_id % 2 = 0 AND event_type <> 'click'
UNION ALL SELECT event_type, 2, 'sell', CAST(user_id AS VARCHAR), floor(sum(value) * 1e6 + 5e-1) / 1e6 FROM events WHERE event_type <> 'click' GROUP BY event_type, user_id HAVING sum(value) > 0
UNION ALL SELECT 'click', 0, 'not_supported', NULL, NULL"""
)
def panic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    brokers = e.select(F.col("event_type").alias("adapter")).distinct().withColumn("close", F.col("adapter") != "click")
    orders = e.select(F.col("event_type").alias("adapter"), F.col("event_id").alias("order_id"), F.when(F.col("event_id") % 2 == 0, "OPEN").otherwise("filled").alias("state"))
    held = e.groupBy(F.col("event_type").alias("adapter"), F.col("user_id").cast("string").alias("symbol")).agg(f6(F.sum("value")).alias("quantity"))
    return services.panic_plan(brokers, orders, held)


@registered(
    f"""WITH {FEATURES} SELECT symbol, sum(volume) AS volume, {s6("median(abs(log_return))")} AS typical_move, {s6("avg(CASE WHEN log_return >= 0 THEN 1e0 ELSE 0e0 END)")} AS up_share, count(log_return) AS n FROM feats WHERE log_return IS NOT NULL GROUP BY symbol"""
)
def symbol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars_features(spark, sf_dir).where("log_return is not null")
    out = df.groupBy("symbol").agg(F.sum("volume").alias("volume"), F.median(F.abs("log_return")).alias("typical_move"), F.avg((F.col("log_return") >= 0).cast("double")).alias("up_share"), F.count("log_return").alias("n"))
    return rounded(out, ("symbol", "volume", "n"), ("typical_move", "up_share"))


@registered(f"WITH {BARS} SELECT * FROM bars WHERE date + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def streamed_hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from a file stream; those that the watermark has not passed are not final yet."""
    bars = live.run_once(live.streamed_bars(live.event_ticks(spark, sf_dir)), "bars")
    return bars.withColumn("date", F.col("date").cast("timestamp_ntz"))


@registered(
    """WITH RECURSIVE m AS (SELECT user_id AS order_id, ts, event_id % 7 AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT order_id, ts, place, i, CAST(-1 AS BIGINT) AS before, place = 0 AS legal FROM m WHERE i = 1
 UNION ALL SELECT m.order_id, m.ts, m.place, m.i, p.now, m.place = p.now + 1 FROM m JOIN (SELECT order_id, i, CASE WHEN NOT legal THEN before WHEN place = 6 THEN -1 ELSE place END AS now FROM r) p ON m.order_id = p.order_id AND m.i = p.i + 1),
s AS (SELECT ['DRAFT', 'CALCULATING', 'READY_FOR_REVIEW', 'COUNTDOWN', 'CONFIRMED', 'SUBMITTED', 'ACKED'] AS names)
SELECT order_id, ts, names[place + 1] AS state, CASE WHEN before >= 0 THEN names[before + 1] END AS previous, legal FROM r, s"""
)
def streamed_order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order state machine over a stream of moves."""
    state = F.element_at(F.array(*[F.lit(s) for s in services.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    moves = live.event_ticks(spark, sf_dir).select(F.col("user_id").alias("order_id"), "ts", state.alias("state"))
    return live.run_once(live.order_lifecycle(moves), "orders").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registered(
    f"""WITH o AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT symbol, min(ts) AS "start", max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n, {s6("sum(value)")} AS total FROM n GROUP BY symbol, session HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of ticks less than ten minutes apart, from a file stream; those that the watermark has passed."""
    made = live.run_once(live.streamed_sessions(live.event_ticks(spark, sf_dir), "10 minutes"), "sessions")
    return made.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", f6("total").alias("total"))


@registered(
    """WITH m AS (SELECT event_id // 7 AS order_id, ts, event_id % 7 AS k FROM events WHERE event_type <> 'error' OR event_id % 3 > 0),
c AS (SELECT *, count(*) OVER o AS before, max(CASE WHEN k = 3 THEN ts END) OVER o AS t3, count(*) FILTER (k < 4) OVER (PARTITION BY order_id) AS ahead, max(CASE WHEN k = 4 THEN ts END) OVER (PARTITION BY order_id) AS t4, max(ts) OVER (PARTITION BY order_id) AS t_last
 FROM m WINDOW o AS (PARTITION BY order_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, ahead = 4 AND (t4 IS NULL OR t4 > t3 + INTERVAL 240 SECOND) AS runs_out, least(before, CASE WHEN ahead = 4 AND (t4 IS NULL OR t4 > t3 + INTERVAL 240 SECOND) THEN 4 ELSE 7 END) AS most FROM c),
p AS (SELECT *, (SELECT count(*) FROM m n WHERE n.order_id = e.order_id AND n.k < e.k AND (SELECT count(*) FROM m x WHERE x.order_id = n.order_id AND x.k < n.k) = n.k) AS reached FROM e),
s AS (SELECT ['DRAFT', 'CALCULATING', 'READY_FOR_REVIEW', 'COUNTDOWN', 'CONFIRMED', 'SUBMITTED', 'ACKED'] AS names)
SELECT order_id, ts, names[k + 1] AS state, CASE WHEN k >= 4 AND runs_out AND ts > t3 + INTERVAL 240 SECOND THEN NULL WHEN reached > 0 THEN names[CASE WHEN runs_out THEN least(reached, 4) ELSE reached END] END AS previous,
 before = k AND NOT (k >= 4 AND runs_out) AS legal FROM p, s
UNION ALL SELECT DISTINCT order_id, t3 + INTERVAL 240 SECOND, 'EXPIRED', 'COUNTDOWN', TRUE FROM (SELECT order_id, max(t3) OVER (PARTITION BY order_id) AS t3, runs_out, t_last FROM e)
 WHERE runs_out AND (t_last > t3 + INTERVAL 240 SECOND OR t3 + INTERVAL 240 SECOND <= (SELECT max(ts) FROM m) - INTERVAL 1 HOUR)"""
)
def streamed_order_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven events in a row are an order's moves, some of them missing; a countdown runs out after four minutes."""
    state = F.element_at(F.array(*[F.lit(s) for s in services.STATES]), (F.col("event_id") % 7 + 1).cast("int"))
    moves = live.event_ticks(spark, sf_dir).where("symbol <> 'error' or event_id % 3 > 0").select(F.floor(F.col("event_id") / 7).alias("order_id"), "ts", state.alias("state"))
    return live.run_once(order_life(moves, 240), "order-life", live.KEYED_STORE).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registered(
    """WITH o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT o.event_id AS order_id, o.user_id AS account, o.ts, coalesce(f.event_id, -1) AS fill_id, f.ts AS filled FROM o LEFT JOIN f ON o.user_id = f.user_id AND f.ts >= o.ts AND f.ts <= o.ts + INTERVAL 2 HOUR
WHERE f.event_id IS NOT NULL OR o.ts + INTERVAL 2 HOUR < least((SELECT max(ts) FROM o), (SELECT max(ts) FROM f)) - INTERVAL 1 HOUR"""
)
def streamed_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the same user's clicks of the next two hours (fill_id -1: none), both from file streams."""
    orders = live.event_ticks(spark, sf_dir).where("symbol = 'purchase'").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("account"), "ts")
    fills = live.event_ticks(spark, sf_dir).where("symbol = 'click'").select(F.col("event_id").alias("fill_id"), F.col("user_id").alias("account"), F.col("ts").alias("filled"))
    made = live.run_once(live.orders_with_fills(orders, fills), "fills")
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "filled")} | {"fill_id": F.coalesce("fill_id", F.lit(-1).cast("long"))})


@registered(
    f"""WITH s AS (SELECT event_type AS symbol, value, unnest(generate_series(0, 3)) AS k, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events)
SELECT symbol, b - k * INTERVAL 15 MINUTE AS "start", b - k * INTERVAL 15 MINUTE + INTERVAL 1 HOUR AS "end", max(value) AS high, min(value) AS low, {s6("avg(value)")} AS mean, count(*) AS n
FROM s GROUP BY 1, 2, 3 HAVING b - k * INTERVAL 15 MINUTE + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""".replace("HAVING b - k * INTERVAL 15 MINUTE + INTERVAL 1 HOUR", 'HAVING "end"')
)
def streamed_sliding_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = live.run_once(live.sliding_bars(live.event_ticks(spark, sf_dir)), "sliding")
    return made.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz"), "mean": f6("mean")})


@registered(
    """WITH o AS (SELECT ['gemini', 'tradingview', 'robinhood_crypto'][CAST(o_custkey % 3 AS INTEGER) + 1] AS adapter, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS symbol, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'filled' END AS state FROM orders),
h AS (SELECT ['gemini', 'robinhood_crypto'][CAST(c_nationkey % 2 AS INTEGER) + 1] AS adapter, c_mktsegment AS symbol, CAST(count(*) AS DOUBLE) AS quantity FROM customer GROUP BY 1, 2),
s AS (SELECT adapter, 'get_open_orders' AS action, 'ok' AS status, order_id AS target FROM o WHERE state = 'open'
 UNION ALL SELECT adapter, 'cancel_all_orders', 'ok', order_id FROM o WHERE state = 'open' AND adapter <> 'tradingview'
 UNION ALL SELECT adapter, 'get_positions', 'ok', symbol FROM h)
SELECT adapter, action, status, count(*) AS n, min(target) AS low, max(target) AS high FROM s GROUP BY 1, 2, 3
UNION ALL SELECT * FROM (VALUES ('tradingview', 'cancel_all_orders', 'cancel_all_orders_not_supported', 0, NULL, NULL), ('tradingview', 'get_positions', 'get_positions_not_supported', 0, NULL, NULL), ('nobody', 'get_positions', 'not_registered', 0, NULL, NULL), ('gemini', 'get_recent_fills', 'get_recent_fills_not_supported', 0, NULL, NULL))"""
)
def broker_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers recorded as brokers' tables, and reads, cancel-all and holdings through the router."""
    path = live.scratch(spark, "brokers")
    orders = table(spark, sf_dir, "orders").select(
        F.element_at(F.array(*map(F.lit, ("gemini", "tradingview", "robinhood_crypto"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("adapter"),
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderpriority").alias("symbol"), F.lit("buy").alias("side"), F.col("o_totalprice").alias("quantity"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("filled").alias("state"),
    )
    held = table(spark, sf_dir, "customer").select(F.element_at(F.array(F.lit("gemini"), F.lit("robinhood_crypto")), (F.col("c_nationkey") % 2 + 1).cast("int")).alias("adapter"), F.col("c_mktsegment").alias("symbol")).groupBy("adapter", "symbol").agg(F.count("*").cast("double").alias("quantity"))
    for adapter in ("gemini", "tradingview", "robinhood_crypto"):
        orders.where(F.col("adapter") == adapter).drop("adapter").write.json(f"{path}/{adapter}.orders.jsonl")
    held.where("adapter = 'gemini'").drop("adapter").write.json(f"{path}/gemini.positions.jsonl")
    held.where("adapter = 'robinhood_crypto'").drop("adapter").write.json(f"{path}/robinhood_crypto.holdings.jsonl")
    asked = [(a, x) for a in ("gemini", "tradingview", "robinhood_crypto") for x in ("get_open_orders", "cancel_all_orders", "get_positions")] + [("nobody", "get_positions"), ("gemini", "get_recent_fills")]
    found = brokers.router_reads(spark, path, spark.createDataFrame(asked, "adapter string, action string"))
    target = F.coalesce(F.get_json_object("item", "$.order_id"), F.get_json_object("item", "$.symbol"))
    return found.groupBy("adapter", "action", "status").agg(F.count("item").alias("n"), F.min(target).alias("low"), F.max(target).alias("high"))


@registered(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a, generate_subscripts(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is'), 1) - 1 AS position FROM pages)
SELECT page_id, CAST(position AS INTEGER) AS position, regexp_extract(a, 'href="([^"]*)"', 1, 'is') AS href,
trim(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')) AS link FROM l"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's links by a table function."""
    html_tables.register(spark)
    return spark.sql("SELECT page_id, position, href, link FROM {pages}, LATERAL html_links(html)", pages=table(spark, sf_dir, "pages").select("page_id", "html"))


@registered(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a, generate_subscripts(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is'), 1) - 1 AS position FROM pages),
c AS (SELECT page_id, position, regexp_extract(a, 'href="([^"]*)"', 1, 'is') AS href, trim(regexp_replace(a, '<[^>]*>', '', 'gs')) AS link FROM l)
SELECT page_id, 1 AS depth, 'inner' AS table_id, CAST(position AS INTEGER) AS row_no, 'No. ' || position || ' é' AS label, link, href FROM c"""
)
def nested_news_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links laid out as a table inside a table's cell, unquoted, in single quotes and unclosed, read back."""
    html_tables.register(spark)
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = F.transform(anchors, lambda a, k: F.concat(F.lit("<TR class=x><td>No. "), k.cast("string"), F.lit(" &eacute;<td align='left'>"), a))
    html = F.concat(F.lit("<table><tr><td>outer<table id=inner>"), F.array_join(rows, ""), F.lit("</table><td>end"))
    laid = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return spark.sql(
        "SELECT page_id, depth, table_id, row_no, cells[0].text AS label, cells[1].link AS link, cells[1].href AS href FROM {laid}, LATERAL html_rows(html) WHERE table_id = 'inner'", laid=laid
    )


@registered()
def discovered_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = features.robust_scale(features.preprocess(weekly_bars(spark, sf_dir), 12), ["log_return", "realized_vol", "dollar_volume"])
    scaled = panel.select("date", "symbol", *[F.col(f"{c}_scaled").alias(c) for c in ("log_return", "realized_vol", "dollar_volume")]).na.drop()
    return regimes.discover_regimes(scaled, 7, 126, 4, 4, 6)


@registered()
def factor_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars_features(spark, sf_dir)
    return volatility.cluster_volatility(df, stand_in_regimes(df), 10, 5)


@registered()
def walk_forward_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.model_table(bars_features(spark, sf_dir), [1, 2, 5])
    return walk_forward(rows, ["ret_lag_1", "ret_lag_2", "ret_lag_5", "realized_vol", "dollar_volume"], 100, 50)


@registered()
def walk_forward_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As walk_forward_gbt, one job a tree level for all folds, as a panel of any size is grown."""
    rows = features.model_table(bars_features(spark, sf_dir), [1, 2, 5])
    return walk_forward(rows, ["ret_lag_1", "ret_lag_2", "ret_lag_5", "realized_vol", "dollar_volume"], 100, 50, small_cells=0)


@registered()
def fixed_radius_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = features.robust_scale(features.preprocess(weekly_bars(spark, sf_dir), 12), ["log_return", "realized_vol", "dollar_volume"])
    scaled = panel.select("date", "symbol", *[F.col(f"{c}_scaled").alias(c) for c in ("log_return", "realized_vol", "dollar_volume")]).na.drop()
    return regimes.discover_regimes(scaled, 7, 126, 4, 4, 6, manifold=0, radius=0.8)


@registered()
def research_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline on hourly bars with the smoke market's settings."""
    return run_pipeline(hourly_bars(spark, sf_dir), MARKETS["smoke"]).executed


@registered()
def generated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated_ohlcv(spark, ["AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "META", "TSLA", "AMD"])


@registered(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a, generate_subscripts(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is'), 1) - 1 AS position FROM pages)
SELECT CAST(page_id AS VARCHAR) AS ticker, CAST(position AS INTEGER) AS position, 'Jan-01-24 & ' || position AS datetime_text, regexp_extract(a, 'href="([^"]*)"', 1, 'is') AS url,
trim(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')) AS headline FROM l"""
)
def news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a news table; each page's links make up its table, with one row of a single cell that is no news."""
    links = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = F.transform(links, lambda a, k: F.concat(F.lit("<tr><td>Jan-01-24 &amp; "), k.cast("string"), F.lit("</td><td>"), a, F.lit("</td></tr>")))
    html = F.concat(F.lit('<table class="x" id="news-table">'), F.array_join(rows, ""), F.lit("<tr><td>no news</td></tr></table>"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("ticker"), html.alias("html"))
    return services.news_rows(pages)


@registered(
    f"""SELECT {s6("(SELECT sum(value) / 1e4 FROM events)")} AS unrealized_pnl, {s6("(SELECT sum(abs(value * (user_id % 3))) FROM events)")} AS exposure,
(SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events) AS symbols"""
)
def pnl_of_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in JSON, as lists and as objects that hold one under several names, into a PnL snapshot."""
    row = F.struct(F.col("event_type").alias("symbol"), (F.col("value") / 1e4).alias("unrealized_pnl"), F.col("value").alias("quantity"), (F.col("user_id") % 3).cast("double").alias("mark_price"))
    other = F.struct(F.col("event_type").alias("asset"), (F.col("value") / 1e4).alias("unrealizedPnL"), F.col("value").alias("qty"), (F.col("user_id") % 3).cast("double").alias("price"))
    kind = F.col("event_id") % 4
    payload = F.when(kind == 0, F.to_json(F.array(row))).when(kind == 1, F.to_json(F.struct(F.array(other).alias("holdings")))).when(kind == 2, F.to_json(F.struct(F.array(row).alias("positions")))).otherwise(F.to_json(other))
    positions = services.position_rows(table(spark, sf_dir, "events").select(payload.alias("payload")))
    out = services.pnl_snapshot(executed(spark, sf_dir), positions, "2024-01-15")
    total = F.aggregate(F.map_values("exposure_by_symbol"), F.lit(0.0), lambda a, v: a + v)
    out = out.withColumns({"symbols": F.array_join(F.array_sort(F.map_keys("exposure_by_symbol")), ","), "exposure": total})
    return rounded(out, ("symbols",), ("unrealized_pnl", "exposure"))


@registered(
    f"""WITH {executed_sql('rust')}, ids AS (SELECT *, row_number() OVER (ORDER BY date, symbol) - 1 AS order_id FROM ex)
SELECT order_id, date, symbol, cost <= expected_edge_bps AND cost <= 20e0 AS approve, {s6("cost")} AS predicted_shortfall_bps,
CASE WHEN cost <= expected_edge_bps AND cost <= 20e0 THEN 'ok' WHEN cost > expected_edge_bps THEN 'predicted_shortfall_exceeds_expected_edge' ELSE 'predicted_shortfall_exceeds_max_shortfall' END AS reason,
{s6("CASE WHEN cost <= expected_edge_bps AND cost <= 20e0 THEN size ELSE 0e0 END")} AS adjusted_size FROM ids"""
)
def request_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests, one a date, decoded, decided, encoded as responses and read again."""
    rows = sizing.with_order_id(executed(spark, sf_dir))
    order = F.struct("order_id", "symbol", "side", "size", "expected_edge_bps", F.col("vol_forecast").alias("forecast_vol"), "pofi")
    requests = rows.groupBy("date").agg(F.to_json(F.struct(F.collect_list(order).alias("orders"), F.lit(20.0).alias("max_shortfall_bps"))).alias("request"))
    responses = services.encode_decisions(services.decide(services.decode_requests(requests)), "date")
    decision = "struct<decisions:array<struct<order_id:bigint,symbol:string,approve:boolean,predicted_shortfall_bps:double,reason:string,adjusted_size:double>>>"
    read = responses.select("date", F.explode(F.from_json("response", decision)["decisions"]).alias("d")).select("date", "d.*")
    return rounded(read, ("order_id", "date", "symbol", "approve", "reason"), ("predicted_shortfall_bps", "adjusted_size"))


@registered(
    """WITH i AS (SELECT ['tradingview', 'gemini', 'forex_com', 'nobody'][event_id % 4 + 1] AS adapter, ['ping', 'submit_order', 'cancel_order', 'close_position'][user_id % 4 + 1] AS action, user_id AS target FROM events),
r AS (SELECT adapter, action, target, adapter <> 'nobody' AND (action = 'submit_order' OR adapter <> 'tradingview') AS ok FROM i)
SELECT adapter, action, count(*) FILTER (ok) AS ok_count, count(*) FILTER (NOT ok) AS refused_count, count(DISTINCT CASE WHEN ok THEN target END) AS targets_count FROM r GROUP BY 1, 2"""
)
def router_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings, submissions, cancellations and closings by adapter: how many went through and were refused."""
    adapters, actions = ("tradingview", "gemini", "forex_com", "nobody"), ("ping", "submit_order", "cancel_order", "close_position")

    def pick(names: tuple[str, ...], key: str) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(key) % 4 + 1).cast("int"))

    intents = table(spark, sf_dir, "events").select(pick(adapters, "event_id").alias("adapter"), pick(actions, "user_id").alias("action"), F.col("user_id").cast("string").alias("target"))
    return services.router_counts(services.router_results(services.capabilities(spark), intents))


@registered(
    """SELECT event_type AS adapter, 1 AS step, 'cancel' AS action, CAST(event_id AS VARCHAR) AS target, CAST(NULL AS DOUBLE) AS quantity FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_type, 2, CASE WHEN sum(value) > 100 THEN 'sell' ELSE 'no_position' END, '7', CASE WHEN sum(value) > 100 THEN floor((sum(value) - 100) * 1e6 + 5e-1) / 1e6 END FROM events WHERE user_id = 7 GROUP BY event_type"""
)
def close_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closing one symbol does: all open orders of each adapter are cancelled, then its position is sold."""
    e = table(spark, sf_dir, "events")
    orders = e.select(F.col("event_type").alias("adapter"), F.col("event_id").alias("order_id"), F.when(F.col("event_id") % 3 == 0, "Working").otherwise("executed").alias("state"))
    held = e.groupBy(F.col("event_type").alias("adapter"), F.col("user_id").cast("string").alias("symbol")).agg((f6(F.sum("value") - 100)).alias("quantity"))
    return services.close_plan(orders, held, "7")


@registered(
    """WITH b AS (SELECT c_mktsegment AS adapter, c_custkey AS place, substr(n_name, 1, 3) AS currency, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS available FROM customer JOIN nation ON n_nationkey = c_nationkey),
w AS (SELECT DISTINCT c_mktsegment AS adapter, lower(n_name) || 'usd' AS symbol FROM customer, nation)
SELECT w.adapter, w.symbol, arg_min(available, place) FILTER (contains(upper(w.symbol), upper(currency)) AND available IS NOT NULL) AS quantity,
CASE WHEN count(*) FILTER (contains(upper(w.symbol), upper(currency)) AND available IS NOT NULL) = 0 THEN 'no_position' ELSE 'close_position' END AS action
FROM w JOIN b ON w.adapter = b.adapter GROUP BY 1, 2"""
)
def sellable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance to sell for each symbol: the first one whose currency is a part of it."""
    nation = table(spark, sf_dir, "nation")
    held = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    balances = held.select(F.col("c_mktsegment").alias("adapter"), F.col("c_custkey").alias("place"), F.substring("n_name", 1, 3).alias("currency"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("available"), F.lit(None).cast("double").alias("amount"))
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("adapter")).distinct()
    # 25 nations for each segment.
    wanted = segments.crossJoin(F.broadcast(nation.select(F.concat(F.lower("n_name"), F.lit("usd")).alias("symbol"))))
    return services.sellable(balances, wanted)


@registered(
    "WITH "
    + FEATURES
    + """, vols AS (SELECT symbol, date, realized_vol AS vol_forecast FROM feats WHERE realized_vol IS NOT NULL AND hour(date) % 3 = 0),
pred AS (SELECT symbol, date, next_return AS target, avg(log_return) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS prediction FROM feats),
known AS (SELECT * FROM pred WHERE target IS NOT NULL AND prediction IS NOT NULL),
own AS (SELECT *, coalesce(CASE WHEN count(target) OVER w >= 5 THEN stddev_samp(target) OVER w END, 0.01e0) AS own FROM known WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
pv AS (SELECT own.symbol, own.date, target, prediction, coalesce(vols.vol_forecast, own) AS vol_forecast FROM own LEFT JOIN vols ON own.symbol = vols.symbol AND own.date = vols.date)"""
    + CHAIN
    + f" SELECT symbol, date, trade_allowed, {', '.join(f'{s6(c)} AS {c}' for c in ('vol_forecast', 'signal_z', 'position', 'realized_pnl'))} FROM ord"
)
def orders_with_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose volatility is joined by date and symbol; where there is none, each symbol's own deviation counts."""
    df = bars_features(spark, sf_dir)
    vol = df.where("realized_vol is not null").where(F.hour("date") % 3 == 0).select("symbol", "date", F.col("realized_vol").alias("vol_forecast"), F.lit(0).alias("regime"))
    predictions = df.select("symbol", "date", F.col("next_return").alias("target"), F.avg("log_return").over(by_symbol().rowsBetween(-2, 0)).alias("prediction")).na.drop()
    return rounded(sizing.build_orders(predictions, vol, z_window=20), ("symbol", "date", "trade_allowed"), ("vol_forecast", "signal_z", "position", "realized_pnl"))


@registered(
    f"""WITH {FEATURES}, {STAND_IN}, {VI}, pr AS (SELECT symbol, date, next_return AS target FROM feats WHERE next_return IS NOT NULL),
j AS (SELECT p.*, coalesce(r.regime, -1) AS regime FROM pr p ASOF LEFT JOIN reg r ON p.symbol = r.symbol AND p.date >= r.date),
fig AS (SELECT (SELECT median(abs(target)) * 10000e0 FROM j) AS edge, (SELECT median(realized_vol) FROM feats) AS vol, (SELECT avg(vi) FROM vis) AS vi, (SELECT avg(CASE WHEN regime >= 0 THEN 1e0 ELSE 0e0 END) FROM j) AS support),
k AS (SELECT least(edge / 18e0, 1e0) AS edge, 1e0 / (1 + greatest(vi, 0e0)) AS stability, greatest(0e0, 1 - least(vol * 5000e0 / 18e0, 1e0)) AS feas, support FROM fig)
SELECT 'crypto_24x7_trend' AS strategy_id, {s6("(edge * 0.4e0 + stability * 0.2e0 + feas * 0.3e0 + support * 0.1e0) * 1.15e0")} AS score, {s6("stability")} AS stability, {s6("feas")} AS feasibility FROM k"""
)
def rank_with_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best suggestion, with the share of known regimes and the mean variation of information counted in."""
    df = bars_features(spark, sf_dir)
    assigned = stand_in_regimes(df)
    predictions = regimes.attach_regime(df.where("next_return is not null").select("symbol", "date", F.col("next_return").alias("target")), assigned)
    vol = df.select(F.col("realized_vol").alias("vol_forecast"))
    best = services.rank_strategies(spark, "crypto", predictions, vol, regimes.variation_of_information(assigned), 18.0, 1)
    return rounded(best, ("strategy_id",), ("score", "stability", "feasibility"))


@registered(f"WITH {BARS} SELECT symbol, date, {', '.join(f'{s6(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars")
def bars_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as CSV with a header and read again, types and dates restored."""
    path = live.scratch(spark, "bars")
    hourly_bars(spark, sf_dir).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")).write.option("header", True).csv(path)
    return rounded(read_ohlcv(spark, path), ("symbol", "date"), ("open", "high", "low", "close", "volume"))


@registered("SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id FROM events WHERE event_id % 5 = 0 AND event_id % 2 = 0")
def terminated_from_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terminated runs of an audit log of JSON lines: live terminations only."""
    path = live.scratch(spark, "audit")
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_id") % 5 == 0, "terminate_strategy_run").otherwise("submit_order")
    artifacts.append_audit(e.select(F.col("ts").cast("string").alias("timestamp_utc"), action.alias("action"), F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_id") % 2 == 0, "live").otherwise("dry_run").alias("detail")), path)
    return artifacts.terminated_runs(spark, path)
