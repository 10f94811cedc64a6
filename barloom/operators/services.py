"""Ranking, review, PnL, order control and broker tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from barloom.functions.columns import exact_quantiles, first_truthy
from barloom.operators.sizing import shortfall_bps

# The strategy registry.
REGISTRY = (
    ("stocks_regime_momentum", "stocks", "momentum", "balanced", ("log_return", "regime", "vol_forecast"), ("daylight_hours", "max_slippage_guard")),
    ("stocks_mean_reversion", "stocks", "mean_reversion", "conservative", ("z_score", "regime", "realized_vol"), ("max_position_cap",)),
    ("forex_session_breakout", "forex", "breakout", "balanced", ("session_overlap", "macro_event_flag", "vol_forecast"), ("spread_guard", "max_slippage_guard")),
    ("crypto_24x7_trend", "crypto", "trend", "aggressive", ("funding_bias", "liquidity_score", "regime"), ("always_on_risk_checks", "max_drawdown_stop")),
    ("intl_fx_neutral_momentum", "intl_stocks", "momentum", "balanced", ("exchange_calendar", "fx_decomposition", "regime"), ("session_alignment", "fx_hedge_required")),
)
# The life of an order, the open and filled states, the brokers and what each can do.
STATES = ("DRAFT", "CALCULATING", "READY_FOR_REVIEW", "COUNTDOWN", "CONFIRMED", "SUBMITTED", "ACKED")
OPEN_STATES = ("queued", "open", "pending", "working")
FILLED_STATES = ("filled", "executed")
BROKERS = (
    ("tradingview", "webhook", True, False, False),
    ("fidelity_active_trader", "ticket", True, True, True),
    ("robinhood_crypto", "rest", True, True, True),
    ("gemini", "rest", True, True, True),
    ("forex_com", "rest", True, True, True),
)
# The review's checks in order, and what it advises where one is breached.
MITIGATIONS = {
    "no_orders": "Re-run analyze/suggest until at least one order is generated.",
    "approval_rate_below_threshold": "Lower position sizing or improve execution edge before live submit.",
    "shortfall_limit_exceeded": "Tighten slippage caps or reduce turnover for this run.",
    "max_daily_loss_exceeded": "Pause execution and reduce risk budget before resuming.",
    "symbol_exposure_exceeded": "Reduce per-symbol max position cap and regenerate orders.",
}
# The Greeks of which any three make a surface.
GREEKS = ("delta", "gamma", "theta", "vega", "rho")


def registry(spark: SparkSession, market: str | None = None) -> DataFrame:
    df = spark.createDataFrame([(k, tuple(list(x) if isinstance(x, tuple) else x for x in row)) for k, row in enumerate(REGISTRY)], "place int, row struct<strategy_id string, market string, family string, risk_profile string, required_features array<string>, constraints array<string>>").select("place", "row.*")
    return df if market is None else df.where(F.lower(F.trim("market")) == market.strip().lower())


def rank_strategies(spark: SparkSession, market: str, predictions: DataFrame, vol: DataFrame, vi: DataFrame, cap_bps: float = 20.0, n: int | None = None) -> DataFrame:
    """Registry rows of the market scored by realised edge, stability and feasibility, best first; the first n of
    them where n is given. One pass over predictions and vol each, or one over both if they are one table."""
    moves = predictions.withColumn("_move", F.abs("target"))
    if vol is predictions:
        middle = exact_quantiles(moves, ["_move", "vol_forecast"], (0.5,), "_m")
    else:
        middle = exact_quantiles(moves, ["_move"], (0.5,), "_m").crossJoin(exact_quantiles(vol, ["vol_forecast"], (0.5,), "_m"))
    steady = vi.agg(F.coalesce(F.avg("vi"), F.lit(1.0)).alias("vi"))
    support = F.coalesce(F.avg((F.col("regime") >= 0).cast("double")), F.lit(0.0)) if "regime" in predictions.columns else F.lit(0.0)
    figures = middle.select((F.coalesce(F.col("_m__move")[0], F.lit(0.0)) * 10000).alias("edge_bps"), F.coalesce(F.col("_m_vol_forecast")[0], F.lit(0.01)).alias("vol")).crossJoin(steady)
    figures = figures.crossJoin(predictions.agg(support.alias("support"))) if "regime" in predictions.columns else figures.withColumn("support", support)
    rows = registry(spark, market).crossJoin(F.broadcast(figures))
    cap = max(cap_bps, 1e-6)
    mult = F.when(F.col("risk_profile") == "conservative", 0.85).when(F.col("risk_profile") == "aggressive", 1.15).otherwise(1.0)
    rows = rows.withColumns({"stability": 1 / (1 + F.greatest("vi", F.lit(0.0))), "feasibility": F.greatest(F.lit(0.0), 1 - F.least(F.col("vol") * 5000 / cap, F.lit(1.0)))})
    score = (F.least(F.col("edge_bps") / cap, F.lit(1.0)) * 0.4 + F.col("stability") * 0.2 + F.col("feasibility") * 0.3 + F.col("support") * 0.1) * mult
    reasons = F.array(
        F.format_string("edge_bps=%.2f", "edge_bps"), F.format_string("stability=%.3f", "stability"), F.format_string("execution_feasibility=%.3f", "feasibility"), F.concat(F.lit("risk_profile="), "risk_profile")
    )
    rows = rows.withColumns({"score": score, "reasons": reasons}).withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.col("score"), F.lit(1.0))), "expected_edge_bps": F.col("edge_bps") * mult * F.col("feasibility")})
    best = rows.orderBy(F.desc("score"), F.desc("expected_edge_bps"), "place").select("strategy_id", "market", "family", "risk_profile", "score", "confidence", "expected_edge_bps", "stability", "feasibility", "reasons")
    return best if n is None else best.limit(n)


def top_symbols(executed: DataFrame, n: int = 5) -> DataFrame:
    return executed.groupBy("symbol").agg(F.sum("executed_pnl").alias("net_pnl")).orderBy(F.desc("net_pnl"), "symbol").limit(n)


def review(orders: DataFrame, executed: DataFrame, min_approval: float = 0.6, max_shortfall: float = 20.0, max_daily_loss: float = 0.03, max_exposure: float = 0.25, require_orders: bool = True) -> DataFrame:
    """One row: the decision, its breached checks in order, and the figures behind them. Days are summed once, and
    all figures follow from them; orders are counted apart unless they are the executed ones. Without executed
    columns the orders' own PnL and position are looked at; a check whose column is absent is not made."""
    have = executed.columns

    def pick(*names: str) -> str | None:
        return next((name for name in names if name in have), None)

    pnl, position = pick("executed_pnl", "realized_pnl"), pick("exec_position", "position")
    none = F.lit(None).cast("double")
    days = executed.groupBy(F.to_date("date").alias("day")).agg(
        F.count("*").alias("n"),
        (F.sum(F.col("approve").cast("double")) if "approve" in have else none).alias("approved"),
        (F.max("predicted_shortfall_bps") if "predicted_shortfall_bps" in have else none).alias("shortfall"),
        (F.sum(pnl) if pnl else none).alias("pnl"),
        (F.max(F.abs(position)) if position else none).alias("exposure"),
    )
    row = days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_executed"),
        F.coalesce(F.sum("approved") / F.sum("n"), F.lit(0.0)).alias("approval_rate"),
        F.coalesce(F.max("shortfall"), F.lit(0.0)).alias("max_shortfall_bps"),
        F.coalesce(F.min("pnl"), F.lit(0.0)).alias("worst_day"),
        F.coalesce(F.max("exposure"), F.lit(0.0)).alias("max_exposure"),
    )
    row = row.withColumn("n_orders", F.col("n_executed")) if orders is executed else row.crossJoin(orders.agg(F.count("*").alias("n_orders")))
    some = F.col("n_executed") > 0
    tests = dict(
        zip(
            MITIGATIONS,
            (
                F.lit(require_orders) & (F.col("n_orders") == 0),
                some & F.lit("approve" in have) & (F.col("approval_rate") < min_approval),
                some & (F.col("max_shortfall_bps") > max_shortfall),
                some & (F.col("worst_day") < -abs(max_daily_loss)),
                some & (F.col("max_exposure") > max_exposure),
            ),
        )
    )
    breached = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    advice = F.array_compact(F.array(*[F.when(test, MITIGATIONS[name]) for name, test in tests.items()]))
    return row.withColumns({"breached_checks": breached, "mitigations": advice}).withColumn("decision", F.when(F.size("breached_checks") == 0, "GO").otherwise("NO_GO"))


def position_rows(payload: DataFrame, json: str = "payload") -> DataFrame:
    """Rows of a broker's position payload: a list, or an object that holds one under positions, results or
    holdings, or else is the row itself. Zero and empty values fall through to the next name."""
    numbers = ("unrealized_pnl", "unrealizedPnL", "quantity", "qty", "size", "mark_price", "mark", "price", "exposure")
    item = f"struct<{','.join(f'{c}:string' for c in ('symbol', 'asset', 'instrument'))},{','.join(f'{c}:double' for c in numbers)}>"
    listed = F.from_json(F.col(json), f"array<{item}>")
    held = F.from_json(F.col(json), f"struct<positions:array<{item}>,results:array<{item}>,holdings:array<{item}>>")
    single = F.array(F.from_json(F.col(json), item))
    is_list = F.trim(F.col(json)).startswith("[")
    rows = payload.select(F.explode(F.when(is_list, listed).otherwise(F.coalesce(held["positions"], held["results"], held["holdings"], single))).alias("p"))

    def number(*names: str) -> Column:
        return F.coalesce(first_truthy(*[F.col(f"p.{n}") for n in names]), F.lit(0.0))

    symbol = F.coalesce(*[F.nullif(F.col(f"p.{n}"), F.lit("")) for n in ("symbol", "asset", "instrument")], F.lit("UNKNOWN"))
    exposure = F.abs(F.coalesce("p.exposure", number("quantity", "qty", "size") * number("mark_price", "mark", "price")))
    return rows.select(symbol.alias("symbol"), number("unrealized_pnl", "unrealizedPnL").alias("unrealized_pnl"), exposure.alias("exposure"))


def pnl_snapshot(executed: DataFrame, positions: DataFrame, as_of: str, fee_bps: float = 1.0) -> DataFrame:
    """One row: realised, unrealised and daily PnL, fees, net, and maps by symbol. Each table is summed by symbol
    once; totals and map come from those sums, and the maps are as large as the symbol list. Without executed_pnl and
    exec_position, realized_pnl and position take their places; what has no column counts as 0, without symbols the map
    is empty."""
    have = set(executed.columns)
    none = F.lit(None).cast("double")
    pnl = next((F.col(c) for c in ("executed_pnl", "realized_pnl") if c in have), none)
    size = next((F.col(c) for c in ("exec_position", "position") if c in have), none)
    today = F.to_date("date") == F.lit(as_of).cast("date") if "date" in have else F.lit(False)
    symbol = F.col("symbol") if "symbol" in have else F.lit(None).cast("string")
    by_symbol = executed.groupBy(symbol.alias("symbol")).agg(F.sum(pnl).alias("v"), F.sum(F.when(today, pnl)).alias("day"), F.sum(F.abs(size)).alias("size"))
    held = positions.groupBy("symbol").agg(F.sum("exposure").alias("v"), F.sum("unrealized_pnl").alias("u"))
    as_map = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("symbol").isNotNull() & F.col("v").isNotNull(), F.struct("symbol", "v")))))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0.0))

    row = by_symbol.agg(total("v").alias("realized_pnl"), total("day").alias("daily_pnl"), (total("size") * (fee_bps / 10000)).alias("fees"), as_map.alias("by_symbol"))
    row = row.crossJoin(held.agg(total("u").alias("unrealized_pnl"), as_map.alias("exposure_by_symbol")))
    return row.withColumn("net_pnl", F.col("realized_pnl") + F.col("unrealized_pnl") - F.col("fees"))


def intent_breaches(quantity: Column, portfolio: Column, daily_pnl: Column, max_symbol: float = 0.25, max_portfolio: float = 1.0, max_loss: float = 0.03) -> Column:
    return F.array_compact(F.array(F.when(F.abs(quantity) > max_symbol, "symbol_exposure_limit"), F.when(F.abs(portfolio) > max_portfolio, "portfolio_exposure_limit"), F.when(daily_pnl < -abs(max_loss), "daily_loss_limit")))


def advance(names: Iterable[str | None], at: int = -1) -> Iterator[tuple[str | None, bool, int]]:
    """For each move (its state before, whether it is legal, the place after): the next state only, and a first move to
    the first state. An illegal move leaves an order where it was; the last state ends its life."""
    for name in names:
        before, legal = STATES[at] if at >= 0 else None, at + 1 < len(STATES) and name == STATES[at + 1]
        if legal:
            at = at + 1 if at + 2 < len(STATES) else -1
        yield before, legal, at


def state_audit(moves: DataFrame, key: str = "order_id", at: str = "ts", state: str = "state") -> DataFrame:
    """Every move with the state its order was in and whether the life of an order allows it. Moves of one order are
    a group, in the order of their times and then their states."""

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([at, state], kind="stable")
        found = list(advance(frame[state]))
        return frame.assign(previous=[p for p, _, _ in found], legal=[ok for _, ok, _ in found])

    schema = StructType([*moves.schema.fields, StructField("previous", StringType()), StructField("legal", BooleanType())])
    return moves.groupBy(key).applyInPandas(judged, schema)


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BROKERS), "adapter string, route string, submit boolean, cancel boolean, close boolean")


def order_payload(adapter: Column, symbol: Column, side: Column, quantity: Column, order_type: Column, price: Column) -> Column:
    """The dry-run payload that an adapter would send, as JSON."""
    plain = F.struct(symbol.alias("symbol"), side.alias("side"), quantity.alias("quantity"), order_type.alias("order_type"))
    kind = F.when(order_type == "market", "exchange market").otherwise("exchange limit")
    exchange = F.struct(symbol.alias("symbol"), side.alias("side"), quantity.alias("amount"), price.alias("price"), kind.alias("order_type"))
    return F.when(adapter == "gemini", F.to_json(exchange)).otherwise(F.to_json(plain))


def close_plan(open_orders: DataFrame, positions: DataFrame, symbol: str, mode: str = "flatten") -> DataFrame:
    """What closing a symbol would do, in order: cancel all the adapter's open orders, then, to flatten,
    sell the position if there is one."""
    cancel = open_orders.where(F.lower("state").isin(*OPEN_STATES)).select("adapter", F.lit(1).alias("step"), F.lit("cancel").alias("action"), F.col("order_id").cast("string").alias("target"), F.lit(None).cast("double").alias("quantity"))
    if mode != "flatten":
        return cancel
    held = positions.where(F.col("symbol") == symbol)
    close = held.select("adapter", F.lit(2).alias("step"), F.when(F.col("quantity") > 0, "sell").otherwise("no_position").alias("action"), F.col("symbol").alias("target"), F.when(F.col("quantity") > 0, F.col("quantity")).alias("quantity"))
    return cancel.unionByName(close)


def panic_plan(brokers: DataFrame, open_orders: DataFrame, positions: DataFrame) -> DataFrame:
    """What closing everything would do for each broker that can: cancel its open orders, then sell what it
    holds; brokers that cannot are named as such."""
    able = brokers.where("close").select("adapter")
    cancel = open_orders.where(F.lower("state").isin(*OPEN_STATES)).join(able, "adapter", "left_semi").select("adapter", F.lit(1).alias("step"), F.lit("cancel").alias("action"), F.col("order_id").cast("string").alias("target"), F.lit(None).cast("double").alias("quantity"))
    close = positions.where("quantity > 0").join(able, "adapter", "left_semi").select("adapter", F.lit(2).alias("step"), F.lit("sell").alias("action"), F.col("symbol").alias("target"), "quantity")
    unable = brokers.where("not close").select("adapter", F.lit(0).alias("step"), F.lit("not_supported").alias("action"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("quantity"))
    return cancel.unionByName(close).unionByName(unable)


def routed(intents: DataFrame, brokers: DataFrame) -> DataFrame:
    """Order intents (adapter, ...) with the route that the broker takes them by, and whether it takes them
    and can cancel them; an unknown broker takes none."""
    known = brokers.select("adapter", "route", F.col("submit").alias("accepted"), F.col("cancel").alias("cancellable"))
    return intents.join(known, "adapter", "left").na.fill(False, ["accepted", "cancellable"])


def router_results(brokers: DataFrame, intents: DataFrame) -> DataFrame:
    """What each intent (adapter, action, target) comes to: its status and the route it takes. Actions: ping (read
    access), submit_order, cancel_order, close_position. An adapter that is not registered knows no action."""
    able = brokers.select("adapter", "route", "submit", "cancel", "close", F.coalesce(F.col("route") != "webhook", F.lit(False)).alias("ping"))
    rows = intents.select("adapter", "action", "target").join(able, "adapter", "left")
    can = F.when(F.col("action") == "ping", F.col("ping")).when(F.col("action") == "submit_order", F.col("submit")).when(F.col("action") == "cancel_order", F.col("cancel")).when(F.col("action") == "close_position", F.col("close"))
    status = F.when(F.col("route").isNull(), "not_registered").when(can, "ok").otherwise(F.concat("action", F.lit("_not_supported")))
    return rows.select("adapter", "action", "target", "route", status.alias("status"))


def router_counts(results: DataFrame) -> DataFrame:
    """(adapter, action, ok_count, refused_count, targets_count): what a router reports of its results."""
    ok = F.col("status") == "ok"
    return results.groupBy("adapter", "action").agg(F.count_if(ok).alias("ok_count"), F.count_if(~ok).alias("refused_count"), F.count_distinct(F.when(ok, F.col("target"))).alias("targets_count"))


def sellable(balances: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: symbols to close. Each with the amount of the first of its adapter's balances (place, currency,
    available, amount) whose currency is a part of the symbol and which has an amount; none: no_position."""
    amount = F.coalesce("available", "amount")
    rows = wanted.select("adapter", "symbol").join(balances.withColumn("_amount", amount).select("adapter", "place", "currency", "_amount"), "adapter", "left")
    fits = F.upper("symbol").contains(F.upper("currency")) & F.col("_amount").isNotNull()
    found = rows.groupBy("adapter", "symbol").agg(F.min(F.when(fits, F.struct("place", "_amount"))).alias("found"))
    return found.select("adapter", "symbol", F.col("found._amount").alias("quantity"), F.when(F.col("found").isNull(), "no_position").otherwise("close_position").alias("action"))


REQUEST = "struct<orders:array<struct<order_id:bigint,symbol:string,side:string,size:double,expected_edge_bps:double,forecast_vol:double,pofi:double>>,max_shortfall_bps:double>"


def decode_requests(requests: DataFrame, json: str = "request") -> DataFrame:
    """One row for each order of a JSON request {orders, max_shortfall_bps}; other columns stay. A request that is
    no such JSON fails the job, as the decoder it stands for ends its run."""
    keep = [c for c in requests.columns if c != json]
    parsed = requests.select(*keep, F.from_json(json, REQUEST, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select(*keep, F.col("r.max_shortfall_bps").alias("max_shortfall_bps"), F.explode("r.orders").alias("o")).select(*keep, "max_shortfall_bps", "o.*")


def decide(orders: DataFrame) -> DataFrame:
    """The decision of each decoded order; sign and flow come with the order, so nothing is shuffled."""
    rows = orders.withColumn("predicted_shortfall_bps", shortfall_bps(F.col("size"), F.col("forecast_vol"), F.col("pofi"), F.col("side"), "rust"))
    over_edge, over_cap = F.col("predicted_shortfall_bps") > F.col("expected_edge_bps"), F.col("predicted_shortfall_bps") > F.col("max_shortfall_bps")
    reason = F.when(~over_edge & ~over_cap, "ok").when(over_edge, "predicted_shortfall_exceeds_expected_edge").otherwise("predicted_shortfall_exceeds_max_shortfall")
    rows = rows.withColumns({"approve": ~over_edge & ~over_cap, "reason": reason})
    return rows.withColumn("adjusted_size", F.when(F.col("approve"), F.col("size")).otherwise(0.0))


def encode_decisions(decisions: DataFrame, *keys: str) -> DataFrame:
    """One JSON response for each key: its decisions in the order of their numbers."""
    fields = ("order_id", "symbol", "approve", "predicted_shortfall_bps", "reason", "adjusted_size")
    made = F.transform(F.sort_array(F.collect_list(F.struct(*fields))), lambda d: F.struct(*[d[f].alias(f) for f in fields]))
    return decisions.groupBy(*keys).agg(F.to_json(F.struct(made.alias("decisions"))).alias("response"))


def terminate(runs: DataFrame, run_id: str) -> DataFrame:
    """The set of terminated runs with one more; adding one twice changes nothing."""
    new = runs.sparkSession.createDataFrame([(run_id,)], "run_id string")
    return runs.select("run_id").unionByName(new).distinct()


def greek_combinations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *c) for k, c in enumerate(combinations(GREEKS, 3))], "place int, x string, y string, z string")


def mock_surface(spark: SparkSession, has_chain: bool = False) -> DataFrame:
    """The placeholder surface sin(x / 10) cos(y / 10) on 21 strikes and 30 days; empty where there is a chain."""
    strikes = spark.range(21).select((90.0 + F.col("id")).alias("x"))
    days = spark.range(30).select((F.col("id") + 1).cast("double").alias("y"))
    grid = strikes.crossJoin(F.broadcast(days)).select("x", "y", (F.sin(F.col("x") / 10) * F.cos(F.col("y") / 10)).alias("z"))
    return grid.where(F.lit(not has_chain))


# The named HTML entities that news pages use, the ampersand's last.
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#x27", "'"), ("nbsp", " "), ("ndash", "\u2013"), ("mdash", "\u2014"), ("lsquo", "\u2018"), ("rsquo", "\u2019"), ("ldquo", "\u201c"), ("rdquo", "\u201d"), ("hellip", "\u2026"), ("amp", "&"))


def plain_text(html: Column) -> Column:
    """The text of a piece of HTML: no tags, entities decoded, no space around it."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(out)


def headlines(pages: DataFrame) -> DataFrame:
    """(page_id, position, url, headline) of every link of a page, in page order."""
    links = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(links).alias("position", "a"))
    return rows.select("page_id", "position", F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("url"), plain_text(F.col("a")).alias("headline"))


def news_rows(pages: DataFrame) -> DataFrame:
    """(ticker, position, datetime_text, headline, url) of the rows with two cells or more in a page's table
    whose id is news-table; headline and url are the row's first link's."""
    body = F.regexp_extract("html", r'(?is)<table\b[^>]*\bid="news-table"[^>]*>(.*?)</table>', 1)
    rows = pages.select("ticker", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("position", "row"))
    cells = rows.withColumn("cells", F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))).where("size(cells) >= 2")
    link = F.regexp_extract(F.col("cells")[1], r"(?is)<a\b[^>]*>(.*?)</a>", 1)
    return cells.select("ticker", "position", plain_text(F.col("cells")[0]).alias("datetime_text"), plain_text(link).alias("headline"), F.regexp_extract(F.col("cells")[1], r'(?is)<a\b[^>]*?href="([^"]*)"', 1).alias("url"))


def write_news(pages: DataFrame, path: str) -> None:
    """The raw pages as text, one file part each task, and the headlines as CSV."""
    pages.select("ticker", "html").write.mode("overwrite").json(f"{path}/raw")
    news_rows(pages).write.mode("overwrite").option("header", True).csv(f"{path}/headlines")


def equity_rows(series: DataFrame) -> DataFrame:
    """The bars of a series that is held as one JSON array a column."""
    names = ("open", "high", "low", "close")
    zipped = F.arrays_zip(*[F.from_json(c, "array<double>").alias(c) for c in names])
    return series.select(F.posexplode(zipped).alias("place", "bar")).select("place", *[f"bar.{c}" for c in names])


def mock_equity(spark: SparkSession, periods: int = 30, seed: int = 42) -> DataFrame:
    """A made-up series of bars, one JSON array a column."""
    day = spark.range(periods).select("id", (100 + F.rand(seed)).alias("open"), (101 + F.rand(seed + 1)).alias("high"), (99 + F.rand(seed + 2)).alias("low"), (100 + F.rand(seed + 3)).alias("close"))

    def in_order(c: str) -> Column:
        return F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("id", c))), lambda s: s[c])).alias(c)

    return day.agg(*[in_order(c) for c in ("open", "high", "low", "close")])
