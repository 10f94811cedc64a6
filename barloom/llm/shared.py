"""Small helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns can neither clash nor travel; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under the one that spark.checkpoint.dir names, which all executors share. Where
    that is unset, a local session, whose one machine sees all its files, uses a temporary folder; any other
    session must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "barloom-checkpoints")
    return f"{folder.rstrip('/')}/barloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that cut_lineage() has written in this application; results that still read them fail."""
    delete(spark, shared_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: later steps neither recompute it
    nor depend on one executor's disk. Unlike after checkpoint(), Spark then plans with the table's
    true size; the size that it carries through checkpoints is squared by each join of a loop."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of cut_lineage() that nothing reads any more."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df.table_path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """What runs inside sends at most so many rows at once to a Python worker: with whole texts in them, the default
    of 10,000 rows holds hundreds of MB in the executor and its worker. The session's setting is put back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
