"""Streams: bars from ticks, sessions, and the order state machine."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.errors import ExecutionError
from barloom.operators.services import advance


def streamed_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """ticks: symbol, ts (timestamp), value. A bar is final once the watermark passes its end; later ticks
    are dropped."""
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol")
    made = bars.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
    return made.select("symbol", F.col("window.start").alias("date"), "open", "high", "low", "close", "volume")


def streamed_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    made = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def sliding_bars(ticks: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """As streamed_bars over windows of `width` that begin every `slide`: a tick counts in each one that holds it."""
    made = ticks.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "symbol").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    return made.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "high", "low", "mean", "n")


def orders_with_fills(orders: DataFrame, fills: DataFrame, within: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """orders: order_id, account, ts; fills: fill_id, account, filled. Each order with every fill of its account at or
    after it and at most `within` later; one without any is emitted, with NULLs, once the watermark (the slower stream's)
    has passed the last moment a fill could come. Both watermarks bound the state: an order is kept for `within` and the
    lateness, a fill for the lateness. Rows that come behind the watermark are dropped."""
    o = orders.withWatermark("ts", late).alias("o")
    f = fills.withWatermark("filled", late).withColumnRenamed("account", "_account").alias("f")
    near = F.expr(f"account = _account and filled >= ts and filled <= ts + interval {within}")
    return o.join(f, near, "left_outer").select("order_id", "account", "ts", "fill_id", "filled")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which all executors share. Where that is unset, a
    local session, whose one machine sees all its files, uses a temporary folder; any other must set it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ExecutionError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = os.path.join(tempfile.gettempdir(), "barloom-streams")
    return f"{shared.rstrip('/')}/barloom-scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: The state store that processors with timers need.
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """Streams that start inside use the provider; the session's own setting is put back."""
    before = spark.conf.get(_STORE, None)
    if provider:
        spark.conf.set(_STORE, provider)
    try:
        yield
    finally:
        if provider:
            spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def run_once(stream: DataFrame, name: str, store: str | None = None) -> DataFrame:
    """Run a stream over what its source holds now, into a Parquet sink with its own checkpoint, exactly once."""
    spark = stream.sparkSession
    base = scratch(spark, f"stream-{name}")
    with state_store(spark, store):
        _run(stream, base)
    delete(spark, f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has put in scratch paths; results that still read them fail."""
    delete(spark, os.path.dirname(scratch(spark, "")))


def _run(stream: DataFrame, base: str) -> None:
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream of ticks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "user_id", "event_id")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    at = state.get[0] if state.exists else -1
    moves = pd.concat(frames).sort_values("ts", kind="stable")
    rows = []
    for (ts, name), (previous, legal, after) in zip(zip(moves["ts"], moves["state"]), advance(moves["state"], at)):
        rows.append((key[0], ts, name, previous, legal))
        at = after
    if at >= 0:
        state.update((at,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(rows, columns=["order_id", "ts", "state", "previous", "legal"])


def order_lifecycle(moves: DataFrame) -> DataFrame:
    """moves: order_id, ts, state. Each move with the state the order was in and whether it was legal; an
    illegal one leaves the order where it was. An acknowledged order's life is over: its state, one number, is
    dropped, and a new life begins with its next first state, wherever the batches end."""
    return moves.groupBy("order_id").applyInPandasWithState(_advance, "order_id long, ts timestamp, state string, previous string, legal boolean", "at int", "append", "NoTimeout")
