"""Sources and sinks around the engine: polled and pushed feeds, report files, order books, settings."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition


def with_retries(call: Callable[[], str], tries: int = 3, wait: Callable[[int], float] = lambda k: 2.0**k, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; errors are tried again after growing waits, the last one is raised."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            sleep(wait(k))
    raise ValueError("tries must be positive")


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` replaced by its value; a name without one stays as it is."""
    values = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: values.get(m[1], m[0]), text)


class _Part(InputPartition):
    def __init__(self, ticker: str) -> None:
        self.ticker = ticker


class _Rest(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(t) for t in self.options["tickers"].split(",") if t]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import urllib.request

        url = self.options["url"].replace("{ticker}", partition.ticker)
        body = with_retries(lambda: urllib.request.urlopen(url, timeout=30).read().decode())
        yield partition.ticker, body


class RestSource(DataSource):
    """``spark.read.format("tideline_rest").option("url", ...{ticker}...).option("tickers", "A,B")``: ticker, body.

    One partition per ticker; bodies are parsed by the functions in ``market``.
    """

    @classmethod
    def name(cls) -> str:
        return "tideline_rest"

    def schema(self) -> str:
        return "ticker string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Rest(dict(self.options))


def read_rest(spark: SparkSession, url: str, tickers: list[str]) -> DataFrame:
    spark.dataSource.register(RestSource)
    return spark.read.format("tideline_rest").option("url", url).option("tickers", ",".join(tickers)).load()


class _PagedPart(InputPartition):
    def __init__(self, ticker: str) -> None:
        self.ticker = ticker


class _Paged(DataSourceReader):
    """Pages of one ticker after another; what is read already lies in ``cache`` and isn't asked for again."""

    def __init__(self, options: dict) -> None:
        self.options, self.tickers = options, [t for t in options["tickers"].split(",") if t]

    def pushFilters(self, filters: list) -> Iterator:
        """Equalities and lists on ticker decide which partitions there are."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if isinstance(f, EqualTo) and name == ("ticker",):
                self.tickers = [t for t in self.tickers if t == f.value]
            elif isinstance(f, In) and name == ("ticker",):
                self.tickers = [t for t in self.tickers if t in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_PagedPart(t) for t in self.tickers] or [_PagedPart("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.parse import quote

        if not partition.ticker:
            return
        o, page = self.options, 0
        while page is not None:
            url = o["url"].replace("{ticker}", quote(partition.ticker, safe="")).replace("{page}", str(page))
            body = _cached(url, o.get("cache"), lambda: with_retries(_getter(url, int(o.get("drill", 0))), int(o.get("tries", 3)), wait=lambda k: float(o.get("pause", 1.0)) * 2.0**k))  # noqa: B023
            yield partition.ticker, page, body
            page = page + 1 if json.loads(body).get("next") else None
            time.sleep(float(o.get("pace", 0.0)))


def _getter(url: str, drill: int) -> Callable[[], str]:
    """Reads a URL; with ``drill`` the first so many tries of every third URL fail, as services do."""
    import urllib.request
    import zlib

    left = [drill if zlib.crc32(url.encode()) % 3 == 0 else 0]

    def get() -> str:
        if left[0]:
            left[0] -= 1
            raise OSError("429 too many requests (drill)")
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.read().decode()

    return get


def _cached(url: str, folder: str | None, call: Callable[[], str]) -> str:
    """A page that was read before, or the call's result, kept beside its final name until it is whole."""
    import hashlib
    import uuid

    if not folder:
        return call()
    path = os.path.join(folder, hashlib.sha256(url.encode()).hexdigest())
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    body = call()
    os.makedirs(folder, exist_ok=True)
    with open(tmp := f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
        f.write(body)
    os.replace(tmp, path)
    return body


class PagedSource(DataSource):
    """``spark.read.format("tideline_pages")``: ticker, page, body of a paged REST service; bodies say ``next`` while there are more.

    Options: ``url`` with {ticker} and {page}, ``tickers``, ``tries`` and ``pause`` (the first wait, doubled
    each time), ``pace`` (seconds between pages of a ticker), ``cache`` (a shared folder: a task that runs
    again takes up where it was), ``drill`` (failures to rehearse). Filters on ticker are pushed down to the partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "tideline_pages"

    def schema(self) -> str:
        return "ticker string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Paged(dict(self.options))


def read_pages(spark: SparkSession, url: str, tickers: list[str], **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    read = spark.read.format("tideline_pages").option("url", url).option("tickers", ",".join(tickers))
    for key, value in options.items():
        read = read.option(key, str(value))
    return read.load()


def pushed_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of messages that a feed's listener drops as text files into a folder: value."""
    return spark.readStream.schema("value string").text(path)


def write_report(page: str, folder: str, name: str) -> str:
    """Writes a page beside its final name and renames it, so readers never see half of it; returns the path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.html")
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(page)
    os.replace(f"{path}.tmp", path)
    return path


def place_orders(orders: DataFrame, send: Callable[[dict], None] | None = None) -> DataFrame:
    """The orders with their status; without ``send`` a dry run. Orders of one rebalancing are few and sent in turn."""
    if send is None:
        return orders.withColumn("status", F.lit("dry_run"))
    for row in orders.orderBy("ticker").toLocalIterator():
        send(row.asDict())
    return orders.withColumn("status", F.lit("sent"))


def broadcast_prices(batch: DataFrame, sinks: list[Callable[[str], None]]) -> int:
    """Sends a micro-batch of latest prices to all sinks as one JSON message; a sink that fails is dropped from the list."""
    message = json.dumps([r.asDict() for r in batch.select("ticker", "price").orderBy("ticker").collect()])  # a row per ticker
    for sink in list(sinks):
        try:
            sink(message)
        except OSError:
            sinks.remove(sink)
    return len(sinks)
