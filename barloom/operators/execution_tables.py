"""Relational tables of the order store, and the text report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.services import top_symbols

# The store's tables and columns.
SCHEMAS = {
    "model_registry": "model_id string, model_type string, hyperparameters string, created_at string, asset_class_tags string",
    "research_runs": "run_id string, model_id string, symbol string, timeframe string, start_date string, end_date string, confidence_score double, rank int",
    "model_evaluations": "eval_id string, model_id string, symbol string, metric_name string, metric_value double, evaluated_at string",
    "execution_batches": "batch_id string, model_id string, asset_profile_id string, window_start string, window_end string, status string",
    "orders": "order_id string, batch_id string, order_config string, order_result string, state string, created_at string, updated_at string",
    "audit_log": "log_id string, batch_id string, order_id string, event_type string, payload string, timestamp string",
}


def create_store(spark, database: str) -> None:
    """The six tables as Parquet tables of a database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in SCHEMAS.items():
        quoted = ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in columns.split(", "))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({quoted}) USING parquet")


def report(executed: DataFrame, metrics: DataFrame, n: int = 5) -> DataFrame:
    """Lines of a Markdown report: the metrics and the top symbols as an HTML table, or a note without orders."""
    top = top_symbols(executed, n).agg(F.sort_array(F.collect_list(F.struct((-F.col("net_pnl")).alias("o"), "symbol", "net_pnl"))).alias("rows"))
    cells = F.transform("rows", lambda r: F.format_string("<tr><td>%s</td><td>%.6f</td></tr>", r["symbol"], r["net_pnl"]))
    table = F.when(F.size("rows") > 0, F.concat(F.lit("<table><tr><th>symbol</th><th>net_pnl</th></tr>"), F.array_join(cells, ""), F.lit("</table>"))).otherwise("No executed orders")
    lines = F.array(F.lit("# Run report"), F.concat(F.lit("metrics: "), F.to_json(F.struct(*metrics.columns))), table)
    return top.crossJoin(metrics).select(F.explode(lines).alias("value"))
