"""Streams with state and receivers: alerts once a day, prices pushed to receivers, a watchlist read anew each batch."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# ---------------------------------------------------------------- alerts once in a window


class _Once(StatefulProcessor):
    """Keeps when each key of a bucket was sent last (microseconds); a timer drops those whose window is over."""

    def __init__(self, seconds: int) -> None:
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "keys array<string>, times array<bigint>")

    def _read(self) -> dict:
        state = self.sent.get() if self.sent.exists() else None
        return dict(zip(*state)) if state else {}

    def _keep(self, sent: dict, watermark: int) -> None:
        """Later rows have times after the watermark (ms): a key whose window ends by then may be sent again and costs no state."""
        live = {k: t for k, t in sent.items() if t + self.span > watermark * 1000}
        if live:
            self.sent.update((list(live), list(live.values())))
            self.handle.registerTimer(-(-(min(live.values()) + self.span) // 1000))
        else:
            self.sent.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat([f[["key", "us"]] for f in rows]).sort_values("us", kind="stable")
        sent, keys, times = self._read(), [], []
        for k, t in zip(frame["key"].tolist(), frame["us"].tolist()):
            last = sent.get(k)
            if last is None or t - last >= self.span:
                keys.append(k)
                times.append(t)
                sent[k] = t
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep(sent, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key": pd.Series(keys, dtype="object"), "us": pd.Series(times, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self._keep(self._read(), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "us": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def alerts_once(alerts: DataFrame, seconds: int = 86_400, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """(key, ts) of the alerts of a stream that are sent: the first of a key, then those ``seconds`` or more after the last one sent.

    State is kept by bucket of keys (a hash), as a visit to the state store costs more than a key's rows: the last times of
    a bucket's keys, dropped by a timer when the watermark passes the window's end, so state is bounded by the keys of one
    window. A bucket's rows of a batch lie in memory at once and are taken in the order of ``ts``; rows later than the
    watermark (``late``) are dropped. ``buckets`` can't change under a checkpoint. Needs the state store ``STORE``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the state's first worker starts without shipped files
    timed = alerts.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", late)
    timed = timed.withColumn("us", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    out = timed.groupBy("bucket").transformWithStateInPandas(_Once(seconds), "key string, us bigint", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("us").alias("ts"))


# ---------------------------------------------------------------- prices to receivers


class _Rows(WriterCommitMessage):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Push(DataSourceStreamArrowWriter):
    """Tasks hand in their last price per ticker; an epoch's commit sends one message to each living receiver."""

    def __init__(self, options: dict) -> None:
        self.folder, self.receivers = options["log"], options["receivers"].split(",")

    def write(self, batches: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.compute as pc

        last: dict = {}
        for batch in batches:  # a row per ticker is kept; a row without a time comes before all others
            rows = pa.table({"ticker": batch["ticker"], "price": batch["price"], "us": pc.fill_null(batch["ts"].cast("int64"), -(2**63))})
            rows = rows.filter(pc.is_valid(rows["price"])).sort_by("us")
            ends = rows.group_by("ticker", use_threads=False).aggregate([("us", "last"), ("price", "last")])
            for t, us, p in zip(*(ends[c].to_pylist() for c in ("ticker", "us_last", "price_last"))):
                if t not in last or us >= last[t][0]:
                    last[t] = (us, p)
        return _Rows([(t, us, p) for t, (us, p) in last.items()])

    def _dead(self) -> set[str]:
        return {n[len("dead-") :] for n in os.listdir(self.folder) if n.startswith("dead-")}

    def commit(self, messages: list, batchId: int) -> None:
        os.makedirs(self.folder, exist_ok=True)
        last: dict = {}
        for m in messages:
            for t, us, p in m.rows if m else ():
                if t not in last or us >= last[t][0]:
                    last[t] = (us, p)
        text = json.dumps({"epoch": batchId, "prices": [{"ticker": t, "price": p} for t, (_, p) in sorted(last.items())]})
        dead = self._dead()
        for path in self.receivers:
            name = os.path.basename(path)
            done = os.path.join(self.folder, f"sent-{batchId}-{name}")
            if name in dead or os.path.exists(done) or not last:
                continue
            try:
                deliver(path, batchId, text)
            except OSError:
                open(os.path.join(self.folder, f"dead-{name}"), "w").close()  # dropped: it gets nothing any more
                continue
            open(done, "w").close()

    def abort(self, messages: list, batchId: int) -> None:
        pass  # nothing was sent: an epoch's messages go out in commit alone


def deliver(path: str, epoch: int, text: str) -> None:
    """A receiver is a folder; a message is a file named by its epoch, so one that comes twice is one message."""
    with open(os.path.join(path, f".{epoch}"), "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(os.path.join(path, f".{epoch}"), os.path.join(path, f"{epoch}.json"))


class PushSink(DataSource):
    """``writeStream.format("tideline_push")`` with ``log`` (a folder for what was sent) and ``receivers`` (comma-separated folders).

    Rows are ticker, price, ts. Each epoch sends every living receiver one message with the last price per
    ticker. A receiver that fails is dropped. Marks per epoch and receiver keep a repeated epoch from being sent twice.
    """

    @classmethod
    def name(cls) -> str:
        return "tideline_push"

    def schema(self) -> str:
        return "ticker string, price double, ts timestamp"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Push(dict(self.options))


def push_prices(ticks: DataFrame, log: str, receivers: list[str], checkpoint: str):
    """Starts the query that pushes a stream's prices; returns it."""
    ticks.sparkSession.dataSource.register(PushSink)
    os.makedirs(log, exist_ok=True)
    rows = ticks.select(F.col("ticker").cast("string").alias("ticker"), F.col("price").cast("double").alias("price"), F.col("ts").cast("timestamp").alias("ts"))
    out = rows.writeStream.format("tideline_push").option("log", log).option("receivers", ",".join(receivers))
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- a watchlist that changes


def watched(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """Tickers of the newest version of a watchlist (rows version, ticker) that is in force at an epoch: version <= epoch."""
    rows = spark.read.schema("version long, ticker string").parquet(path).filter(F.col("version") <= epoch)
    newest = rows.agg(F.max("version").alias("version"))  # one row
    return rows.join(F.broadcast(newest), "version").select("ticker").distinct()


def start_watched(ticks: DataFrame, watchlist: str, path: str, checkpoint: str):
    """Starts the query that keeps the last prices of what is on the watchlist: the list is read anew in each micro-batch,
    so a ticker that joins or leaves counts from the next batch on, without a restart. Versions of the table as in ``upsert_latest``.
    """
    from tideline.streaming.bars import upsert_latest

    keep = upsert_latest(path)

    def write(batch: DataFrame, epoch: int) -> None:
        keep(batch.join(watched(batch.sparkSession, watchlist, epoch), "ticker", "left_semi"), epoch)

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
