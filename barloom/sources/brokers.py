"""Broker tables from recorded (dry-run) responses, and sources named by a configuration.

A broker's table lies in JSON lines under `<adapter>.<kind>.jsonl` in one folder of any store that Spark reads.
Live network access is out of scope."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from barloom.operators.services import BROKERS, FILLED_STATES, OPEN_STATES, capabilities
from barloom.sources.broker_source import KINDS, BrokerTables, recorded_files


def read_broker(spark: SparkSession, path: str, kind: str, adapter: str | None = None) -> DataFrame:
    """One kind of table of one broker (or several, comma-separated), or of all that have it; `adapter` is the first part
    of the file's name."""
    spark.dataSource.register(BrokerTables)
    reader = spark.read.format("broker_tables").option("kind", kind)
    return (reader.option("adapter", adapter) if adapter else reader).load(path)


def stream_broker(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The same table as a stream: lines that are appended, and new files, are read on."""
    spark.dataSource.register(BrokerTables)
    return spark.readStream.format("broker_tables").option("kind", kind).load(path)


#: What a read is served from: a kind of table and the one that takes its place where a broker has no such table.
READS = {"get_positions": ("positions", "holdings"), "get_balances": ("balances", "accounts"), "get_open_orders": ("orders", None), "get_recent_fills": ("fills", None)}


def router_reads(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """requests: (adapter, action). One row for each request with its status and a NULL item, and for those that are ok
    one more for each item (JSON): adapter, action, status, item. Reads: READS; cancel_all_orders names each open order,
    close_all_positions each position above zero. Status: ok where the broker has the table (and can cancel or close),
    <action>_not_supported where not, not_registered for a broker that is not known. Which broker has which table is
    read off the names of the files."""
    has = {kind: {adapter for adapter, _, _ in recorded_files(path, kind)} for kind in KINDS}
    sources = {action: (kind, other) for action, (kind, other) in READS.items()} | {"cancel_all_orders": ("orders", None), "close_all_positions": ("positions", None)}
    served = [(adapter, action) for action, (kind, other) in sources.items() for adapter in sorted(has[kind] | has.get(other, set()))]
    known = [(name, cancel, close) for name, _, _, cancel, close in BROKERS]
    asked = requests.select("adapter", "action").distinct()
    asked = asked.join(F.broadcast(spark.createDataFrame(known, "adapter string, cancel boolean, close boolean")), "adapter", "left")
    asked = asked.join(F.broadcast(spark.createDataFrame(served, "adapter string, action string").withColumn("has", F.lit(True))), ["adapter", "action"], "left")
    may = F.when(F.col("action") == "cancel_all_orders", F.col("cancel")).when(F.col("action") == "close_all_positions", F.col("close")).otherwise(F.lit(True))
    status = F.when(F.col("cancel").isNull(), "not_registered").when(may & F.coalesce("has", F.lit(False)), "ok").otherwise(F.concat("action", F.lit("_not_supported")))
    out = asked.select("adapter", "action", status.alias("status"), F.lit(None).cast("string").alias("item"))
    # At most as many as there are brokers and actions.
    allowed = {action: [r.adapter for r in rows] for action, rows in _by_action(out.where("status = 'ok'").collect()).items()}
    for action, adapters in sorted(allowed.items()):
        kind, other = sources[action]
        for name, wanted in ((kind, [x for x in adapters if x in has[kind]]), (other, [x for x in adapters if x not in has[kind]])):
            if wanted:
                rows = read_broker(spark, path, name, ",".join(wanted))
                if action in ("get_open_orders", "cancel_all_orders"):
                    rows = open_orders(rows)
                if action == "cancel_all_orders":
                    rows = rows.select("adapter", "order_id")
                if action == "close_all_positions":
                    rows = rows.where("quantity > 0").select("adapter", "symbol", "quantity")
                item = F.to_json(F.struct(*[c for c in rows.columns if c != "adapter"]))
                out = out.unionByName(rows.select("adapter", F.lit(action).alias("action"), F.lit("ok").alias("status"), item.alias("item")))
    return out


def _by_action(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r.action, []).append(r)
    return out


def open_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.lower("state").isin(*OPEN_STATES))


def recent_fills(orders: DataFrame) -> DataFrame:
    return orders.where(F.lower("state").isin(*FILLED_STATES))


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A YAML file, found through Spark so that any store works."""
    import yaml

    return yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}


def read_configured(spark: SparkSession, config_path: str) -> DataFrame:
    """The table that a YAML file names: `format`, `path`, `options`, and `adapter_module`, a module whose data
    sources are registered first so that `format` can be one of them."""
    config = read_yaml(spark, config_path)
    if config.get("adapter_module"):
        for kind in vars(importlib.import_module(config["adapter_module"])).values():
            if isinstance(kind, type) and issubclass(kind, DataSource) and kind is not DataSource:
                spark.dataSource.register(kind)
    reader = spark.read.format(config.get("format", "csv")).options(**(config.get("options") or {}))
    reader = reader.schema(config["schema"]) if config.get("schema") else reader
    return reader.load(config["path"]) if config.get("path") else reader.load()


def configured_brokers(spark: SparkSession, folder: str) -> DataFrame:
    """The brokers that have a YAML file of their name in a folder, with what each can do and whether it is enabled
    (not unless its file says so)."""
    files = spark.read.option("pathGlobFilter", "*.yaml").option("wholetext", True).text(folder)
    found = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.yaml$", 1).alias("adapter"), F.col("value").rlike(r"(?m)^enabled:\s*[Tt]rue\s*$").alias("enabled"))
    return capabilities(spark).join(found, "adapter")
