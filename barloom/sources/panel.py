"""Price-and-volume panels: files, and the stand-ins built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.errors import ValidationError

REQUIRED = ("date", "symbol", "open", "high", "low", "close", "volume")
NUMBERS = REQUIRED[2:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(df: DataFrame) -> DataFrame:
    """The panel with its types set: UTC dates without a zone, doubles, NaN as NULL. Further columns stay."""
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValidationError(f"missing columns: {missing}")
    typed = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in NUMBERS}
    return df.withColumns({"date": F.col("date").cast("timestamp").cast("timestamp_ntz")} | typed)


def read_ohlcv(spark: SparkSession, path: str) -> DataFrame:
    """A .parquet path is read as Parquet, any other as CSV with a header."""
    if path.rstrip("/").endswith(".parquet"):
        return checked(spark.read.parquet(path))
    return checked(spark.read.option("header", True).csv(path))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV artifact, or an empty table of the schema where the file is absent."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def generated_ohlcv(spark: SparkSession, symbols: list[str], periods: int = 1400, start: str = "2020-01-01", seed: int = 42) -> DataFrame:
    """A geometric walk for each symbol on business days; drift and volatility differ by symbol."""
    names = spark.createDataFrame([(k, s) for k, s in enumerate(symbols)], "k int, symbol string")
    # Enough calendar days to hold the periods; the running sum below is per symbol.
    days = spark.range(periods * 7 // 5 + 7).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day")).where(F.dayofweek("day").between(2, 6))
    days = days.orderBy("day").limit(periods)
    walk = names.crossJoin(F.broadcast(days))
    shock = 0.0002 + F.col("k") * 0.00002 + (0.012 + (F.col("k") % 4) * 0.002) * F.randn(seed)
    path = F.sum("shock").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    out = walk.withColumn("shock", shock).withColumn("close", (100 + 15 * F.col("k")) * F.exp(path))
    out = out.withColumn("open", F.col("close") * (1 + 0.002 * F.randn(seed + 1)))
    out = out.withColumn("high", F.greatest("open", "close") * (1 + 0.004 * F.rand(seed + 2))).withColumn("low", F.least("open", "close") * (1 - 0.004 * F.rand(seed + 3)))
    return out.select(F.col("day").cast("timestamp_ntz").alias("date"), "symbol", "open", "high", "low", "close", (1e6 * (0.5 + F.rand(seed + 4))).alias("volume"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as bars: the event type is the symbol, an hour the period."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"), "ts", "value")
    return e.groupBy("symbol", "date").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined with part as bars: the brand is the symbol, a week the period."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("date"), price.alias("price"), "l_quantity")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("symbol", "date").agg(F.avg("price").alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("l_quantity").alias("volume"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by user and day on each user's own full calendar; days without events are NULL."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date"), "value")
    seen = e.groupBy("symbol", "date").agg(F.max("value").alias("close"), F.count("*").cast("double").alias("volume"))
    spans = seen.groupBy("symbol").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    calendar = spans.select("symbol", F.explode(F.sequence("low", "high")).alias("date"))
    return calendar.join(seen, ["symbol", "date"], "left")
