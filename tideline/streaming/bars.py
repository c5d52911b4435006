"""Minute-bar streams: parsing, latest prices, bars, alert suppression; each step has a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "array<struct<ev: string, sym: string, ticker: string, o: double, h: double, l: double, c: double, v: double, t: bigint, e: bigint>>"


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows of minute bars from JSON arrays; broken messages and other kinds of events are dropped."""
    events = raw.select(F.explode(F.from_json(F.col(column).cast("string"), EVENT, {"mode": "PERMISSIVE"})).alias("m"))
    bars = events.filter("m.ev = 'AM'").select(F.coalesce("m.sym", "m.ticker").alias("ticker"), F.col("m.c").alias("price"), F.col("m.v").alias("volume"), F.timestamp_millis("m.t").alias("ts"))
    return bars.filter("ticker is not null and price is not null")


def to_bars(ticks: DataFrame, unit: str) -> DataFrame:
    """open, high, low, close, volume (ticks) per ticker and unit of ``ts``."""
    out = ticks.groupBy("ticker", F.date_trunc(unit, "ts").alias("ts"))
    return out.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("volume"))


def window_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same over event-time windows of a stream, with a watermark that bounds its state."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = timed.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("volume")
    )
    return bars.select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def latest_prices(ticks: DataFrame) -> DataFrame:
    """ticker, price and ts of the last tick."""
    return ticks.filter("price is not null").groupBy("ticker").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts"))


def suppress_repeats(alerts: DataFrame, window: str = "24 hours") -> DataFrame:
    """A stream's alerts, each key once within the window."""
    return alerts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", window).dropDuplicatesWithinWatermark(["key"])


def upsert_latest(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: keeps a Parquet table of the last price per ticker, one version folder per batch.

    A batch that runs again after a failure writes the same version again, so the table is exactly once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = latest_prices(batch)
        if epoch > 0:
            now = latest_prices(now.unionByName(spark.read.schema(now.schema).parquet(f"{path}/v{epoch - 1}")))
        now.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


def start_latest(stream: DataFrame, path: str, checkpoint: str):
    """Starts the query that keeps the latest prices under ``path``; returns it."""
    return stream.writeStream.foreachBatch(upsert_latest(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
