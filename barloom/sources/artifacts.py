"""Run artifacts: configuration, metrics, audit log, terminated runs, tickets, error reports, metadata."""

from __future__ import annotations

import hashlib
import json
import platform
import sys
import traceback
import uuid
from dataclasses import fields
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.brokers import read_yaml

AUDIT = "timestamp_utc string, action string, run_id string, order_id string, state string, detail string"


def load_config(spark: SparkSession, path: str, kind: type):
    """A frozen settings object from a YAML file, found through Spark so that any store works; defaults for
    what the file lacks. A file with unknown keys is read for the known ones."""
    found = read_yaml(spark, path)
    names = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in names})


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def append_audit(events: DataFrame, path: str) -> None:
    """JSON lines, appended; columns that an event lacks are null."""
    missing = [f for f in spark_fields(AUDIT) if f not in events.columns]
    events.withColumns({f: F.lit(None).cast("string") for f in missing}).select(*spark_fields(AUDIT)).write.mode("append").option("ignoreNullFields", False).json(path)


def spark_fields(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def terminated_runs(spark: SparkSession, audit_path: str) -> DataFrame:
    """The set of runs that were terminated for good, from the audit log; none where there is no log."""
    try:
        log = read_audit(spark, audit_path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log = spark.createDataFrame([], AUDIT)
    return log.where("action = 'terminate_strategy_run' and detail = 'live'").select("run_id").distinct()


def terminate_run(spark: SparkSession, audit_path: str, run_id: str, live: bool = False, confirmed: bool = False) -> bool:
    """Log the end of a run; True if it had ended before. Without `live` it is a dry run that ends nothing."""
    if live and not confirmed:
        raise PermissionError("a live action needs confirmation")
    before = not terminated_runs(spark, audit_path).where(F.col("run_id") == run_id).isEmpty()
    row = [(datetime.now(timezone.utc).isoformat(), "terminate_strategy_run", run_id, "live" if live else "dry_run")]
    append_audit(spark.createDataFrame(row, "timestamp_utc string, action string, run_id string, detail string"), audit_path)
    return before


def write_tickets(orders: DataFrame, path: str) -> None:
    """Manual order tickets as JSON, one row each, with an id of their own."""
    orders.withColumn("ticket_id", F.expr("uuid()")).write.mode("append").json(path)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Tickets with what became of them: the files under path hold tickets and cancellations, both JSON lines."""
    rows = spark.read.schema("ticket_id string, symbol string, side string, quantity double, cancels string").json(path)
    gone = rows.where("cancels is not null").select(F.col("cancels").alias("ticket_id")).distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_gone"), "cancelled").otherwise("pending_manual_submission")
    return rows.where("ticket_id is not null").join(gone, "ticket_id", "left").select("ticket_id", "symbol", "side", "quantity", status.alias("status"))


def cancel_ticket(spark: SparkSession, path: str, ticket_id: str) -> str:
    """Append a cancellation; the ticket's row stays. Returns cancelled or not_found."""
    if read_tickets(spark, path).where((F.col("ticket_id") == ticket_id) & (F.col("status") != "cancelled")).isEmpty():
        return "not_found"
    spark.createDataFrame([(ticket_id,)], "cancels string").coalesce(1).write.mode("append").json(path)
    return "cancelled"


def log_lines(events: DataFrame, path: str, level: str = "INFO", logger: str = "barloom") -> None:
    """Events with a `message` as structured log lines: timestamp, level, logger, message and the other columns."""
    extra = [c for c in events.columns if c not in ("timestamp", "level", "logger", "message")]
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    events.select(stamp.alias("timestamp"), F.lit(level).alias("level"), F.lit(logger).alias("logger"), "message", *extra).write.mode("append").json(path)


def write_review(report: DataFrame, path: str) -> None:
    """The one row of a review as JSON."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_error_report(spark: SparkSession, error: BaseException, path: str, command: str, run_id: str, keep_traceback: bool = True, **context: str) -> None:
    """One JSON row on a failure, written through Spark so that a cluster's store holds it."""
    text = "".join(traceback.format_exception(error)) if keep_traceback else ""
    row = [(type(error).__name__, str(error), text, command, run_id, datetime.now(timezone.utc).isoformat(), json.dumps(context, sort_keys=True, default=str))]
    columns = "error_type string, message string, traceback string, command string, run_id string, timestamp_utc string, context string"
    spark.createDataFrame(row, columns).coalesce(1).write.mode("append").json(path)


def run_metadata(spark: SparkSession, config: dict, seed: int, config_path: str = "unknown", run_id: str | None = None, commit: str = "unknown") -> DataFrame:
    """One row: run id, UTC time, seed, the SHA-256 of the settings as sorted JSON, and versions."""
    now = datetime.now(timezone.utc)
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    row = [(run_id or now.strftime("run_%Y%m%dT%H%M%SZ"), now.isoformat(), seed, config_path, digest, commit, platform.python_version(), " ".join(sys.argv), uuid.uuid4().hex)]
    return spark.createDataFrame(row, "run_id string, timestamp_utc string, seed long, config_path string, config_hash string, git_commit string, python_version string, command string, row_id string")
