import json

import pytest
from pyspark.sql.datasource import DataSource, DataSourceReader

from barloom import errors
from barloom.operators import execution_tables, services
from barloom.plans.pipeline import Market
from barloom.sources import artifacts, brokers


def test_config_and_metrics(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("vol_window: 7\nreturn_lags: [1, 2]\nunknown: 3\n")
    config = artifacts.load_config(spark, str(tmp_path / "c.yaml"), Market)
    assert config.vol_window == 7 and config.return_lags == (1, 2) and config.vol_gate == 0.75
    (tmp_path / "m.json").write_text(json.dumps({"avg_vi": 0.5, "pre_exec": {"sharpe": 1.0}}, indent=1))
    assert artifacts.read_metrics(spark, str(tmp_path / "m.json")).first().pre_exec.sharpe == 1.0


def test_terminated_runs(spark, tmp_path):
    log = str(tmp_path / "audit")
    assert artifacts.terminated_runs(spark, log).count() == 0
    assert artifacts.terminate_run(spark, log, "r1") is False
    assert artifacts.terminated_runs(spark, log).count() == 0
    with pytest.raises(PermissionError):
        artifacts.terminate_run(spark, log, "r1", live=True)
    assert artifacts.terminate_run(spark, log, "r1", live=True, confirmed=True) is False
    assert artifacts.terminate_run(spark, log, "r1", live=True, confirmed=True) is True
    assert artifacts.terminated_runs(spark, log).count() == 1 and artifacts.read_audit(spark, log).count() == 3


def test_reports_and_tickets(spark, tmp_path):
    try:
        raise ValueError("bad")
    except ValueError as error:
        artifacts.write_error_report(spark, error, str(tmp_path / "errors"), "analyze", "r1", market="stocks")
    row = spark.read.json(str(tmp_path / "errors")).first()
    assert (row.error_type, row.message, json.loads(row.context)) == ("ValueError", "bad", {"market": "stocks"})
    a, b = (artifacts.run_metadata(spark, {"seed": 42, "risk": {"cap": 0.1}}, 42).first() for _ in range(2))
    assert a.config_hash == b.config_hash
    artifacts.write_tickets(spark.createDataFrame([("AAPL", 1.0)], "symbol string, quantity double"), str(tmp_path / "tickets"))
    tickets = str(tmp_path / "tickets")
    made = artifacts.read_tickets(spark, tickets).first()
    assert made.status == "pending_manual_submission" and artifacts.cancel_ticket(spark, tickets, "none") == "not_found"
    assert artifacts.cancel_ticket(spark, tickets, made.ticket_id) == "cancelled"
    assert [r.status for r in artifacts.read_tickets(spark, tickets).collect()] == ["cancelled"] and artifacts.cancel_ticket(spark, tickets, made.ticket_id) == "not_found"


def test_log_lines_and_review(spark, tmp_path):
    artifacts.log_lines(spark.createDataFrame([("order placed", "r1")], "message string, run_id string"), str(tmp_path / "log"), "WARNING")
    line = spark.read.json(str(tmp_path / "log")).first()
    assert (line.level, line.message, line.run_id) == ("WARNING", "order placed", "r1") and line.timestamp.endswith("+00:00")
    df = spark.createDataFrame([], "symbol string, date timestamp_ntz, approve boolean, predicted_shortfall_bps double, executed_pnl double, exec_position double")
    artifacts.write_review(services.review(df, df), str(tmp_path / "review"))
    assert spark.read.json(str(tmp_path / "review")).first().decision == "NO_GO"


def test_kinds_of_failure():
    kinds = (errors.ValidationError, errors.DataError, errors.ComputeError, errors.ExecutionError, errors.BrokerError)
    assert all(issubclass(kind, errors.TradingError) for kind in kinds)


def test_broker_source(spark, tmp_path):
    (tmp_path / "gemini.orders.jsonl").write_text('{"order_id": "1", "symbol": "BTC", "side": "buy", "quantity": 1, "state": "Open"}\n{"order_id": "2", "state": "executed"}\n')
    (tmp_path / "forex_com.orders.jsonl").write_text('{"order_id": "3", "state": "working"}\n')
    orders = brokers.read_broker(spark, str(tmp_path), "orders")
    assert orders.count() == 3 and brokers.open_orders(orders).count() == 2 and brokers.recent_fills(orders).count() == 1
    assert brokers.read_broker(spark, str(tmp_path), "orders", "gemini").count() == 2
    assert {r.adapter for r in orders.collect()} == {"gemini", "forex_com"}
    assert services.routed(orders, services.capabilities(spark)).where("accepted").count() == 3


def test_sources_by_configuration(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("a,b\n1,2\n")
    (tmp_path / "source.yaml").write_text(f"format: csv\npath: {tmp_path / 'bars.csv'}\noptions: {{header: 'true'}}\n")
    assert brokers.read_configured(spark, str(tmp_path / "source.yaml")).first().b == "2"
    (tmp_path / "own.yaml").write_text("adapter_module: tests.test_artifacts\nformat: three_rows\n")
    assert brokers.read_configured(spark, str(tmp_path / "own.yaml")).count() == 3
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "gemini.yaml").write_text("enabled: true\nurl: x\n")
    (tmp_path / "config" / "forex_com.yaml").write_text("enabled: false\n")
    got = {r.adapter: r.enabled for r in brokers.configured_brokers(spark, str(tmp_path / "config")).collect()}
    assert got == {"gemini": True, "forex_com": False}


class ThreeRows(DataSource):
    @classmethod
    def name(cls):
        return "three_rows"

    def schema(self):
        return "x int"

    def reader(self, schema):
        return Three()


class Three(DataSourceReader):
    def read(self, partition):
        yield from ((k,) for k in range(3))


def test_router_and_news(spark, tmp_path):
    intents = spark.createDataFrame([("tradingview", "cancel_order", "1"), ("gemini", "cancel_order", "1"), ("gemini", "cancel_order", "2"), ("other", "ping", None), ("tradingview", "submit_order", "x")], "adapter string, action string, target string")
    results = services.router_results(services.capabilities(spark), intents)
    assert {(r.adapter, r.target): r.status for r in results.collect()} == {("tradingview", "1"): "cancel_order_not_supported", ("gemini", "1"): "ok", ("gemini", "2"): "ok", ("other", None): "not_registered", ("tradingview", "x"): "ok"}
    counts = {(r.adapter, r.action): (r.ok_count, r.refused_count, r.targets_count) for r in services.router_counts(results).collect()}
    assert counts[("gemini", "cancel_order")] == (2, 0, 2) and counts[("tradingview", "cancel_order")] == (0, 1, 0)
    pages = spark.createDataFrame([("A", '<table id="news-table"><tr><td>9:00</td><td><a href="u">Rise &lt;5&gt; &amp; fall</a></td></tr></table>')], "ticker string, html string")
    services.write_news(pages, str(tmp_path / "news"))
    assert spark.read.option("header", True).csv(str(tmp_path / "news/headlines")).first().headline == "Rise <5> & fall"
    assert spark.read.json(str(tmp_path / "news/raw")).count() == 1


def test_store_and_report(spark, tmp_path):
    execution_tables.create_store(spark, "store_test")
    assert {t.name for t in spark.catalog.listTables("store_test")} == set(execution_tables.SCHEMAS)
    spark.sql("DROP DATABASE store_test CASCADE")
    done = spark.createDataFrame([("AAPL", 0.2), ("AAPL", -0.1), ("MSFT", 0.5)], "symbol string, executed_pnl double")
    metrics = spark.createDataFrame([(1.0,)], "sharpe double")
    assert "MSFT" in execution_tables.report(done, metrics, 2).collect()[2].value
    assert execution_tables.report(done.limit(0), metrics).collect()[2].value == "No executed orders"
