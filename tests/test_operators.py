import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import columns
from barloom.operators import forecast, joins, regimes, services, sizing, volatility
from barloom.plans.pipeline import MARKETS, Market, config_hash, export, run_pipeline
from barloom.sources.panel import checked, generated_ohlcv, read_artifact, read_ohlcv, write_parquet

DAY = dt.datetime(2024, 1, 1)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def day(k):
    return DAY + dt.timedelta(days=k)


def test_asof_exact_tie_miss_and_empty(spark):
    left = rows(spark, [("a", day(0), 1), ("a", day(2), 2), ("b", day(2), 3)], "symbol string, date timestamp_ntz, v int")
    right = rows(spark, [("a", day(2), 7), ("a", day(3), 8)], "symbol string, date timestamp_ntz, regime int")
    got = {(r.symbol, r.v): r.regime for r in regimes.attach_regime(left, right).collect()}
    assert got == {("a", 1): -1, ("a", 2): 7, ("b", 3): -1}
    assert {r.regime for r in regimes.attach_regime(left, right.limit(0)).collect()} == {-1}


def test_folds_never_see_their_test_dates(spark):
    data = rows(spark, [("a", day(k), float(k)) for k in range(23)], "symbol string, date timestamp_ntz, x double")
    got = joins.fold_rows(data, 10, 5).groupBy("fold").agg(F.max(F.when(~F.col("is_test"), F.col("date"))).alias("train"), F.min(F.when(F.col("is_test"), F.col("date"))).alias("test"), F.sum(F.col("is_test").cast("int")).alias("n")).collect()
    assert len(got) == 2 and all(r.train < r.test and r.n == 5 for r in got)


def test_folds_are_generated_and_short_tails_dropped(spark):
    data = rows(spark, [("a", day(k), float(k)) for k in range(23)], "symbol string, date timestamp_ntz, x double")
    folds = joins.fold_rows(data, 10, 5)
    assert "NestedLoop" not in plan_of(folds) and "Cartesian" not in plan_of(folds)
    got = sorted((r.fold, r.rank, r.is_test) for r in folds.collect())
    assert got == sorted((f, k, k >= 10 + 5 * f) for f in range(2) for k in range(15 + 5 * f))
    assert joins.fold_rows(data, 20, 5).count() == 0 and joins.fold_rows(data.limit(0), 2, 1).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookback_is_calendar_days_both_ends_included(spark):
    data = rows(spark, [("a", day(k), 1.0) for k in (0, 1, 5, 6, 10)], "symbol string, date timestamp_ntz, x double")
    got = joins.lookback(data, 5, 4)
    pairs = sorted((r.rebalance_date.day, r.date.day) for r in got.collect())
    assert pairs == [(1, 1), (11, 6), (11, 7), (11, 11)]


def test_vi_of_equal_maps_is_nearly_zero(spark):
    data = [(day(k), s, s % 3) for k in (0, 7) for s in range(6)]
    got = regimes.variation_of_information(rows(spark, data, "date timestamp_ntz, symbol int, regime int")).first()
    assert abs(got.vi) < 1e-9 and got.n_overlap == 6


def test_density_labels_and_axes():
    x = np.array([[0.0, 0], [0.1, 0], [0.2, 0], [5, 5], [5.1, 5], [5.2, 5], [50, 50]])
    assert regimes.density_labels(x, 0.8, 3).tolist() == [0, 0, 0, 1, 1, 1, -1]
    rng = np.random.default_rng(5)
    for _ in range(60):
        z = rng.normal(size=(rng.integers(1, 60), rng.integers(1, 4))) * rng.choice([0.5, 1, 2])
        near = ((z[:, None] - z[None]) ** 2).sum(-1) <= 0.64
        core, seen, want = near.sum(1) >= 3, set(), np.full(len(z), -1)
        for first in np.flatnonzero(core):
            front, label = [first], want.max() + 1
            while front:
                k = front.pop()
                if k not in seen:
                    seen.add(k)
                    want[k] = label
                    front += np.flatnonzero(near[k] & core).tolist()
        got = regimes.density_labels(z, 0.8, 3, chunk=7)
        assert (got[core] == want[core]).all()
        assert all(got[k] in want[near[k] & core] if (near[k] & core).any() else got[k] == -1 for k in np.flatnonzero(~core))
    y = np.random.default_rng(0).normal(size=(40, 4)) @ np.diag([5, 1, 1, 1])
    assert abs(np.corrcoef(regimes.principal_axes(y, 1)[:, 0], y[:, 0])[0, 1]) > 0.98
    s = np.random.default_rng(1).uniform(-1, 1, (400, 2))
    found = regimes.independent_axes(s @ np.array([[1.0, 0.6], [0.4, 1.0]]), 2)
    assert np.abs(np.corrcoef(found.T, s.T)[:2, 2:]).max(1).min() > 0.95


@pytest.mark.parametrize("days, every", [(5, 4), (12, 3), (1, 1), (40, 7)])
def test_lookback_moments_against_plain_frames(spark, days, every):
    rng = np.random.default_rng(days)
    data = [(f"s{s}", day(k) + dt.timedelta(hours=int(rng.integers(0, 3)) * 6), None if rng.random() < 0.15 else float(1e6 + rng.normal()), float(k)) for s in range(4) for k in range(45) if rng.random() < 0.7 and not (s == 3 and k > 10)]
    df = rows(spark, data, "symbol string, date timestamp_ntz, x double, y double")
    got = {(r.rebalance_date, r.symbol): (r.x.n, r.x.mean, r.x.m2, r.y.n, r.y.mean) for r in regimes.lookback_moments(df, ("x", "y"), days, every).collect()}
    frame, want = pd.DataFrame(data, columns=["symbol", "date", "x", "y"]), {}
    for on in sorted(set(frame.date))[::every]:
        for s, g in frame[(frame.date <= on) & (frame.date >= on - pd.Timedelta(days=days))].groupby("symbol"):
            x = g.x.dropna()
            want[on.to_pydatetime(), s] = (len(x), pytest.approx(x.mean(), rel=1e-12) if len(x) else None, pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-5, abs=1e-7), len(g), pytest.approx(g.y.mean()))
    assert got == want


def test_moments_repeat_no_rows(spark):
    """126 days every 7: what is repeated are classes of rows in the same lookbacks, made before the repetition."""
    df = spark.range(3000).selectExpr("concat('s', id % 3) as symbol", "timestamp_ntz '2020-01-01' + make_dt_interval(cast(id div 3 as int)) as date", "rand(1) as x")
    classes = joins.lookback_spans(df, 126, 7).groupBy("first", "last").count()
    assert classes.count() < 300 < df.select("date").distinct().count()
    plan = plan_of(regimes.lookback_moments(df, ("x",), 126, 7))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.index("Generate explode") < plan.index("partial_var_pop")


def test_pnl_without_columns(spark):
    none = rows(spark, [], "symbol string, exposure double, unrealized_pnl double")
    ex = rows(spark, [("a", day(0), 2.0, -3.0), ("a", day(1), 1.0, 1.0), (None, day(1), 4.0, 1.0)], "symbol string, date timestamp_ntz, realized_pnl double, position double")
    got = services.pnl_snapshot(ex, none, "2024-01-02", 100).first()
    assert (got.realized_pnl, got.daily_pnl, got.fees, got.by_symbol) == (7.0, 5.0 if day(1).date() == dt.date(2024, 1, 2) else got.daily_pnl, 0.05, {"a": 3.0})
    bare = services.pnl_snapshot(ex.select(F.col("date").alias("when")), none, "2024-01-02").first()
    assert (bare.realized_pnl, bare.daily_pnl, bare.fees, bare.by_symbol) == (0.0, 0.0, 0.0, {})


def test_audit_leaves_an_order_where_it_was(spark):
    data = [(1, day(k), s) for k, s in enumerate(("CALCULATING", "DRAFT", "ACKED", "CALCULATING", None, "READY_FOR_REVIEW", "what"))]
    got = services.state_audit(rows(spark, data, "order_id long, ts timestamp_ntz, state string")).orderBy("ts").collect()
    assert [(r.previous, r.legal) for r in got] == [(None, False), (None, True), ("DRAFT", False), ("DRAFT", True), ("CALCULATING", False), ("CALCULATING", True), ("READY_FOR_REVIEW", False)]


def test_ewma_closed_form_equals_recursion(spark):
    x = np.random.default_rng(3).normal(0, 0.01, 50)
    v = x.var()
    for r in x:
        v = 0.94 * v + 0.06 * r * r
    df = rows(spark, [("a", day(k), float(r)) for k, r in enumerate(x)], "symbol string, date timestamp_ntz, log_return double")
    assert volatility.ewma_vol(df, 0.94, 10).first().vol_forecast == pytest.approx(np.sqrt(v * 10), rel=1e-12)
    assert volatility.ewma_of(x, 0.94, 10) == pytest.approx(np.sqrt(v * 10), rel=1e-12)
    assert np.isnan(volatility.ewma_of(np.zeros(0), 0.94, 10)) and volatility.garch_of(x, 0.94, 10) > 0


def test_garch_has_the_greatest_likelihood():
    rng = np.random.default_rng(7)
    for omega, alpha, beta in ((0.05, 0.1, 0.85), (0.2, 0.2, 0.5)):
        r, v = np.zeros(3000), omega / (1 - alpha - beta)
        for t in range(len(r)):
            r[t] = np.sqrt(v) * rng.normal()
            v = omega + alpha * r[t] ** 2 + beta * v

        def loss(omega, alpha, beta):
            weights = 0.94 ** np.arange(75)
            v, out = (weights * r[:75] ** 2).sum() / weights.sum(), 0.0
            for x in r**2:
                out += np.log(v) + x / v
                v = omega + alpha * x + beta * v
            return out, v

        o, a, b, after = volatility.garch_fit(r**2)
        best, last = loss(o, a, b)
        assert after == pytest.approx(last, rel=1e-9) and best <= loss(omega, alpha, beta)[0] + 1e-6
        assert all(best <= loss(o * p, a * q, min(b * s, 0.9999 - a * q))[0] + 1e-3 for p, q, s in ((0.9, 1, 1), (1.1, 1, 1), (1, 0.9, 1), (1, 1.1, 1), (1, 1, 0.98), (1, 1, 1.02)))
        assert abs(a - alpha) < 0.06 and abs(b - beta) < 0.15
    flat = np.full(40, 0.01)
    assert volatility.garch_of(flat, 0.94, 5) == pytest.approx(0.01, rel=0.05) and volatility.garch_of(np.zeros(40), 0.94, 5) == 0.0


@pytest.mark.parametrize("model", ["ewma", "garch"])
def test_cluster_volatility_against_plain_frames(spark, model):
    rng = np.random.default_rng(2)
    panel = [(f"s{s}", day(k), None if (s == 5 or k == 0) else float(rng.normal(0, 0.01 * (s + 1)))) for s in range(6) for k in range(60)]
    members = [(day(on), f"s{s}", regime) for on in (40, 55, 300) for s, regime in ((0, 0), (1, 0), (2, 0), (3, 1), (5, 2), (9, 0))]
    df, assigned = rows(spark, panel, "symbol string, date timestamp_ntz, log_return double"), rows(spark, members, "date timestamp_ntz, symbol string, regime int")
    near = volatility.lookback_members(df, assigned.withColumnRenamed("date", "on"), 35)
    assert "NestedLoop" not in plan_of(near)
    blocks, _ = volatility.lookback_blocks(df, assigned.withColumnRenamed("date", "on"), 35)
    # At most twice for each regime of its symbol, where a lookback each would be three times.
    assert blocks.groupBy("symbol", "date", "regime").count().where("count > 2").isEmpty()
    got = {(r.date, r.symbol): (r.vol_forecast, r.regime) for r in volatility.cluster_volatility(df, assigned, 35, 5, model).collect()}
    frame, want = pd.DataFrame(panel, columns=["symbol", "date", "x"]), {}
    for (on, regime), g in pd.DataFrame(members, columns=["on", "symbol", "regime"]).groupby(["on", "regime"]):
        sub = frame[(frame.date <= on) & (frame.date >= on - pd.Timedelta(days=35)) & frame.symbol.isin(g.symbol)]
        wide = sub.pivot(index="date", columns="symbol", values="x").dropna(axis=1, how="all").fillna(0.0)
        if wide.empty:
            continue
        x = wide.to_numpy() - wide.to_numpy().mean(0)
        series = wide.to_numpy()[:, 0] if x.shape[1] == 1 else x @ np.linalg.svd(x, full_matrices=False)[2][0]
        value = {"ewma": volatility.ewma_of, "garch": volatility.garch_of}[model](series, 0.94, 5)
        want |= {(on.to_pydatetime(), s): (pytest.approx(value, rel=1e-9), regime) for s in g.symbol}
    assert got == want and (day(40), "s9") in got and (day(40), "s5") not in got


def test_models_learn_a_simple_target():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.1 * x[:, 1]
    assert np.corrcoef(forecast.boosted(x[:300], y[:300], x[300:]), y[300:])[0, 1] > 0.95
    z = x @ np.array([1.0, -0.5, 0.2])
    assert np.corrcoef(forecast.network(x[:300], z[:300], x[300:], epochs=100), z[300:])[0, 1] > 0.95


ORDER = "symbol string, date timestamp_ntz, position double, expected_edge_bps double, vol_forecast double, target double"


@pytest.mark.parametrize(
    "position, edge, vol, cap, variant, cost, approve, reason",
    [
        (0.5, 5.0, 0.04, 50.0, "rust", (4 + 120 * 0.5 * 0.04 + 16 * 0.5) * 1.05, False, "predicted_shortfall_exceeds_expected_edge"),
        (-0.02, 25.0, 0.01, 30.0, "rust", 4 + 120 * 0.02 * 0.01 + 16 * 0.02, True, "ok"),
        (0.5, 25.0, 0.04, 10.0, "rust", (4 + 120 * 0.5 * 0.04 + 16 * 0.5) * 1.05, False, "predicted_shortfall_exceeds_max_shortfall"),
        (0.05, 20.0, 0.02, 35.0, "python", 4 + 120 * 0.05 * 0.02 + 16 * 0.05, True, "ok"),
        (-0.05, -3.0, 0.02, 35.0, "python", 4 + 120 * 0.05 * 0.02 + 16 * 0.05, False, "shortfall_exceeds_edge"),
        (0.05, 20.0, None, 35.0, "rust", None, False, "predicted_shortfall_exceeds_max_shortfall"),
        (0.0, 5.0, 0.01, 35.0, "rust", 4.2, True, "ok"),
    ],
)
def test_execution_decisions(spark, position, edge, vol, cap, variant, cost, approve, reason):
    got = sizing.execution_filter(rows(spark, [("A", DAY, position, edge, vol, 0.1)], ORDER), cap, variant).first()
    assert (got.predicted_shortfall_bps is None) if cost is None else got.predicted_shortfall_bps == pytest.approx(cost)
    assert (got.approve, got.reason) == (approve, reason)
    assert got.adjusted_size == (abs(position) if approve else 0.0)


def test_performance_of_daily_returns(spark):
    r = [0.01, -0.01, 0.005, 0.004, -0.002, 0.003]
    df = rows(spark, [(day(k), x) for k, x in enumerate(r)], "date timestamp_ntz, realized_pnl double")
    got = sizing.performance(df).first()
    s = pd.Series(r)
    assert got.mean_daily_return == pytest.approx(s.mean()) and got.vol_daily_return == pytest.approx(s.std())
    assert got.cum_return == pytest.approx((1 + s).prod() - 1)
    assert sizing.performance(df.limit(0)).first().sharpe == 0.0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 11, 400, 5000):
        x, y = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
        df = rows(spark, [(float(a), float(b), None) for a, b in zip(x, y)] + [(None, float("nan"), None)], "x double, y double, z double").repartition(3)
        got = columns.exact_quantiles(df, ["x", "y", "z"], (0.0, 0.25, 0.5, 0.9, 1.0)).first()
        for values, found in ((x, got.q_x), (y, got.q_y)):
            assert found == pytest.approx(np.quantile(values, (0.0, 0.25, 0.5, 0.9, 1.0)).tolist(), abs=1e-12)
        assert got.q_z == [None] * 5


def test_bracket_of_many_values(spark, monkeypatch):
    """Brackets that hold a part of the values only."""
    monkeypatch.setattr(columns, "BRACKET_ACCURACY", 200)
    df = spark.range(40_000).select((F.pmod(F.col("id") * 7919, F.lit(40_000)) / 7).alias("x"))
    assert columns.exact_quantiles(df, ["x"], (0.25, 0.5)).first().q_x == pytest.approx([39_999 * q / 7 for q in (0.25, 0.5)])


def test_ranking_without_a_cap_and_with_reasons(spark):
    p = rows(spark, [(0.01, 1), (-0.02, -1), (0.03, 0)], "target double, regime int")
    v = rows(spark, [(0.002,), (0.004,)], "vol_forecast double")
    got = services.rank_strategies(spark, "stocks", p, v, rows(spark, [(0.5,)], "vi double"), 0.0, 1).collect()
    assert len(got) == 1 and got[0].strategy_id == "stocks_regime_momentum" and got[0].feasibility == 0.0
    assert got[0].score == pytest.approx(0.4 + 0.2 / 1.5 + 0.1 * 2 / 3)
    assert got[0].reasons == ["edge_bps=200.00", "stability=0.667", "execution_feasibility=0.000", "risk_profile=balanced"]
    assert services.registry(spark).first().required_features == ["log_return", "regime", "vol_forecast"]


def test_review_of_orders_that_were_not_executed(spark):
    df = rows(spark, [("A", day(0), -0.05, 0.3), ("B", day(0), 0.01, -0.1)], "symbol string, date timestamp_ntz, realized_pnl double, position double")
    got = services.review(df, df).first()
    assert got.breached_checks == ["max_daily_loss_exceeded", "symbol_exposure_exceeded"] and got.n_orders == 2
    assert got.worst_day == pytest.approx(-0.04) and got.max_exposure == pytest.approx(0.3)


def test_range_of_crossed_prices(spark):
    got = rows(spark, [(1.0, 4.0, 2.0)], "high double, low double, close double").select(columns.true_range(F.col("high"), F.col("low"), F.col("close")).alias("t"))
    assert got.first().t == 3.0


def test_requests_and_responses(spark):
    request = '{"orders":[{"order_id":2,"symbol":"B","side":"SELL","size":0.1,"expected_edge_bps":50.0,"forecast_vol":0.01,"pofi":0.1},{"order_id":1,"symbol":"A","side":"BUY","size":0.5,"expected_edge_bps":1.0,"forecast_vol":0.01,"pofi":0.1}],"max_shortfall_bps":20.0}'
    df = rows(spark, [("r1", request)], "id string, request string")
    made = services.encode_decisions(services.decide(services.decode_requests(df)), "id").first()
    decisions = json.loads(made.response)["decisions"]
    assert [(d["order_id"], d["approve"], d["reason"], d["adjusted_size"]) for d in decisions] == [(1, False, "predicted_shortfall_exceeds_expected_edge", 0.0), (2, True, "ok", 0.1)]
    with pytest.raises(Exception):
        services.decode_requests(rows(spark, [("r1", "no json")], "id string, request string")).collect()


def test_gross_exposure_of_zero_gives_no_positions(spark):
    df = rows(spark, [("a", day(k), 0.01, 0.0, 0.02) for k in range(3)], "symbol string, date timestamp_ntz, target double, prediction double, vol_forecast double")
    assert {r.position for r in sizing.build_orders(df, None).collect()} == {0.0}


def test_review_no_go_and_mitigations(spark):
    orders = rows(spark, [("AAPL", 0.5)], "symbol string, position double")
    ex = rows(spark, [("AAPL", day(0), False, 25.0, -0.04, 0.3), ("MSFT", day(0), False, 30.0, -0.01, 0.2)], "symbol string, date timestamp_ntz, approve boolean, predicted_shortfall_bps double, executed_pnl double, exec_position double")
    got = services.review(orders, ex).first()
    assert got.decision == "NO_GO" and got.breached_checks == ["approval_rate_below_threshold", "shortfall_limit_exceeded", "max_daily_loss_exceeded", "symbol_exposure_exceeded"]
    assert len(got.mitigations) == 4
    empty = services.review(orders.limit(0), ex.limit(0)).first()
    assert empty.breached_checks == ["no_orders"]


def test_pnl_and_position_payloads(spark):
    ex = rows(spark, [("AAPL", day(0), 0.01, 0.2), ("MSFT", day(0), -0.02, -0.1)], "symbol string, date timestamp_ntz, executed_pnl double, exec_position double")
    payloads = ['[{"symbol":"AAPL","unrealized_pnl":0.03,"quantity":1.0,"mark_price":100.0}]', '{"holdings":[{"asset":"BTC","qty":2,"quantity":0,"price":3}]}', "{}"]
    pos = services.position_rows(rows(spark, [(p,) for p in payloads], "payload string"))
    assert sorted((r.symbol, r.exposure) for r in pos.collect()) == [("AAPL", 100.0), ("BTC", 6.0), ("UNKNOWN", 0.0)]
    got = services.pnl_snapshot(ex, pos, "2024-01-01").first()
    assert got.net_pnl == pytest.approx(-0.01 + 0.03 - 0.3e-4) and got.daily_pnl == pytest.approx(-0.01)
    assert got.by_symbol == {"AAPL": 0.01, "MSFT": -0.02}


def test_state_audit_and_terminate(spark):
    moves = [(1, day(0), "DRAFT"), (1, day(1), "CALCULATING"), (1, day(2), "CONFIRMED"), (2, day(0), "CALCULATING")]
    got = services.state_audit(rows(spark, moves, "order_id long, ts timestamp_ntz, state string")).orderBy("order_id", "ts").collect()
    assert [r.legal for r in got] == [True, True, False, False]
    runs = rows(spark, [("r1",)], "run_id string")
    assert services.terminate(services.terminate(runs, "r2"), "r2").count() == 2


def test_close_plan_and_registry(spark):
    orders = rows(spark, [("gemini", 1, "open"), ("gemini", 2, "filled")], "adapter string, order_id long, state string")
    held = rows(spark, [("gemini", "BTC", 0.0), ("gemini", "ETH", 2.0)], "adapter string, symbol string, quantity double")
    assert [(r.action, r.target) for r in services.close_plan(orders, held, "ETH").orderBy("step").collect()] == [("cancel", "1"), ("sell", "ETH")]
    assert services.close_plan(orders, held, "BTC").orderBy("step").collect()[1].action == "no_position"
    assert services.registry(spark, " Stocks").count() == 2 and services.registry(spark).count() == 5
    assert services.greek_combinations(spark).count() == 10 and services.mock_surface(spark, True).count() == 0


def test_news_rows_and_equity_json(spark):
    html = '<table id="x"><tr><td>a</td><td>b</td></tr></table><table class="t" id="news-table"><tr><td>Jan-01 <b>09:00</b></td><td><a href="http://n/1">Up &amp; <i>away</i></a></td></tr><tr><td>one cell</td></tr></table>'
    got = services.news_rows(spark.createDataFrame([("AAPL", html), ("MSFT", "<p>none</p>"), ("X", None)], "ticker string, html string")).collect()
    assert [(r.ticker, r.datetime_text, r.headline, r.url) for r in got] == [("AAPL", "Jan-01 09:00", "Up & away", "http://n/1")]
    assert services.equity_rows(services.mock_equity(spark, 30)).count() == 30


def test_sources(spark, tmp_path):
    df = generated_ohlcv(spark, ["A", "B"], 30)
    write_parquet(df, str(tmp_path / "p.parquet"))
    assert read_ohlcv(spark, str(tmp_path / "p.parquet")).count() == 60
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert dict(read_ohlcv(spark, str(tmp_path / "c")).dtypes)["close"] == "double"
    with pytest.raises(ValueError, match="volume"):
        checked(df.drop("volume"))
    assert read_artifact(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_pipeline_runs_end_to_end(spark, tmp_path):
    panel = generated_ohlcv(spark, [f"S{k}" for k in range(6)], 120)
    run = run_pipeline(panel, MARKETS["smoke"])
    export(run, str(tmp_path / "out"))
    executed = spark.read.parquet(str(tmp_path / "out/executed"))
    assert executed.count() == run.predictions.count() > 0 and executed.select("order_id").distinct().count() == executed.count()
    assert spark.read.json(str(tmp_path / "out/metrics")).count() == 1
    assert config_hash(Market()) == config_hash(Market()) != config_hash(MARKETS["smoke"])
