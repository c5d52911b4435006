"""Scans of market tables, source fallback, broker parsing, tables with upserts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import scalars as S
from tideline.operators.joins import lookup

WATCHLIST = "ticker string, weight double, notes string, asset_class string, currency string"
HOLDINGS_CSV = "ticker string, description string, asset_class string, quantity double, cost_basis_eur double, currency string"
FX_DEFAULT = {"USDEUR": 0.92, "GBPEUR": 1.17, "AUDEUR": 0.59}
AGGREGATES = "results array<struct<t: bigint, c: double>>"
SNAPSHOTS = "tickers array<struct<ticker: string, day: struct<c: double>, lastTrade: struct<p: double>>>"
T212 = "array<struct<ticker: string, quantity: double, averagePrice: double, currentPrice: double, ppl: double>>"
ETORO = "PublicPortfolio struct<Positions: array<struct<InstrumentName: string, Amount: double, NetProfit: double>>>"


def history(bars: DataFrame, as_of: Column | None = None, days: int = 365) -> DataFrame:
    """Rows within ``days`` before as_of (default: the last date of all)."""
    if as_of is None:
        as_of = F.lit(bars.agg(F.max("dt")).first()[0])
    return bars.filter((F.col("dt") >= F.date_sub(as_of, days)) & (F.col("dt") <= as_of))


def last_price(bars: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """ticker, price: the quote, else the last close."""
    last = bars.filter("close is not null").groupBy("ticker").agg(F.max_by("close", "dt").alias("close"))
    if quotes is None:
        return last.withColumnRenamed("close", "price")
    return last.join(quotes, "ticker", "full").select("ticker", F.coalesce("quote", "close").alias("price"))


def closes(bars: DataFrame) -> DataFrame:
    return bars.filter("close is not null").select("ticker", "dt", "close")


def wide_closes(wide: DataFrame, tickers: list[str]) -> DataFrame:
    """A table with a column per ticker as rows (ticker, dt, close) without nulls."""
    return wide.unpivot(["dt"], tickers, "ticker", "close").filter("close is not null").select("ticker", "dt", "close")


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary's rows, and the secondary's for tickers that the primary lacks."""
    return primary.unionByName(secondary.join(primary.select("ticker").distinct(), "ticker", "left_anti"))


def rest_daily(raw: DataFrame) -> DataFrame:
    """(ticker, body) of daily aggregates as (ticker, dt, close)."""
    rows = raw.select("ticker", F.explode(F.from_json("body", AGGREGATES)["results"]).alias("r"))
    return rows.select("ticker", F.to_date(F.timestamp_millis("r.t")).alias("dt"), F.col("r.c").alias("close"))


def rest_snapshot(raw: DataFrame) -> DataFrame:
    """ticker, price: the day's close, else the last trade; zero counts as missing."""
    rows = raw.select(F.explode(F.from_json("body", SNAPSHOTS)["tickers"]).alias("r"))
    price = F.coalesce(F.nullif("r.day.c", F.lit(0.0)), F.nullif("r.lastTrade.p", F.lit(0.0)))
    return rows.select(F.col("r.ticker").alias("ticker"), price.alias("price")).filter("price is not null")


def fx_rates(closes: DataFrame) -> DataFrame:
    """pair, rate: 1 / last close, or the default of a pair without one."""
    spark = closes.sparkSession
    default = spark.createDataFrame(list(FX_DEFAULT.items()), "pair string, default_rate double")
    last = closes.filter("close is not null").groupBy(F.col("ticker").alias("pair")).agg(F.max_by("close", "dt").alias("close"))
    return default.join(last, "pair", "left").select("pair", F.coalesce(F.try_divide(F.lit(1.0), F.col("close")), "default_rate").alias("rate"))


def percent_factors(raw: DataFrame, names: dict[str, str] | None = None, start: str | None = None) -> DataFrame:
    """Factor tables in percent as fractions, columns trimmed and renamed, from a first date on."""
    out = raw.select("dt", *[(F.col(f"`{c}`") / 100).alias((names or {}).get(c.strip(), c.strip())) for c in raw.columns if c != "dt"])
    return out.filter(F.col("dt") >= F.to_date(F.lit(start))) if start else out


def ibkr_positions(rows: DataFrame, fx: DataFrame) -> DataFrame:
    """Parsed statement rows as holdings: stock, etf, fund and bond lines; bonds at mark/100 x face."""
    from tideline.operators.portfolio import DEFAULT_FX

    coupon = S.bond_coupon("symbol")
    bond = (F.col("category") == "BOND") | coupon.isNotNull()
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_FX.items() for x in kv])
    mv = F.coalesce(F.col("position_value"), F.when(bond, F.col("mark") / 100 * F.col("quantity")).otherwise(F.col("mark") * F.col("quantity")))
    rate = F.coalesce("rate_eur", default[F.col("currency")], F.lit(1.0))
    kept = rows.filter(F.col("category").isin("STK", "ETF", "FUND", "BOND")).join(lookup(fx), "currency", "left")
    return kept.select(F.col("symbol").alias("ticker"), F.when(bond, "bond").otherwise("equity").alias("asset_class"), coupon.alias("coupon"), S.bond_maturity("symbol").alias("maturity"), "quantity", (mv * rate).alias("market_value_eur"))


def t212_positions(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.explode(F.from_json("body", T212)).alias("r"))
    mv = F.col("r.currentPrice") * F.col("r.quantity")
    return rows.select(S.broker_ticker("r.ticker").alias("ticker"), F.col("r.quantity").alias("quantity"), mv.alias("market_value_eur"), F.col("r.ppl").alias("pnl_eur"), F.lit("EUR").alias("currency"))


def etoro_positions(raw: DataFrame, usd: float) -> DataFrame:
    from tideline.operators.portfolio import INSTRUMENTS

    names = F.create_map(*[F.lit(x) for kv in INSTRUMENTS.items() for x in kv])
    rows = raw.select(F.explode(F.from_json("body", ETORO)["PublicPortfolio"]["Positions"]).alias("r"))
    return rows.select(F.coalesce(names[F.col("r.InstrumentName")], "r.InstrumentName").alias("ticker"), (F.col("r.Amount") * usd).alias("market_value_eur"), (F.col("r.NetProfit") * usd).alias("pnl_eur"))


def priced_csv(holdings: DataFrame, last: DataFrame, fx: DataFrame) -> DataFrame:
    """Quantities at the last price and the rate of their currency; 0 without a price."""
    joined = holdings.join(last, "ticker", "left").join(lookup(fx), "currency", "left")
    return joined.withColumn("market_value_eur", F.coalesce(F.col("price") * F.col("rate_eur") * F.col("quantity"), F.lit(0.0)))


def table_rows(pages: DataFrame) -> DataFrame:
    """Link texts of list items as a catalogue: page_id, place, name, ticker (dots as dashes)."""
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<li><a href=\"[^\"]*\">([^<]*)</a></li>"), F.lit(1))).alias("place", "name"))
    return items.withColumn("ticker", S.dot_dash("name"))


def fresh(cache: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Cached rows not older than ``days``."""
    return cache.filter(F.datediff(as_of, F.to_date("written")) <= days)


def universe(watch: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Watchlist tickers, then the first ``most`` members (by place) that aren't on it: ticker, origin, place."""
    extra = members.join(watch, "ticker", "left_anti").orderBy("place").limit(most)
    first = watch.select("ticker", F.lit("watchlist").alias("origin"), F.lit(0).cast("long").alias("place"))
    return first.unionByName(extra.select("ticker", F.lit("member").alias("origin"), F.col("place").cast("long").alias("place")))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WATCHLIST).csv(path, header=True)


def last_rows(history: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker, oldest first in ``place``."""
    w = W.partitionBy("ticker")
    kept = history.withColumn("_r", F.row_number().over(w.orderBy(F.desc("dt")))).filter(F.col("_r") <= n)
    return kept.withColumn("place", F.row_number().over(w.orderBy("dt")).cast("long")).drop("_r")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def save_upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces rows of the table at ``path`` by those of ``new`` with the same keys, in a new version folder."""
    from tideline.operators.joins import upsert

    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    versions = sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(root) if x.getPath().getName()[:1] == "v") if fs.exists(root) else []
    out = upsert(spark.read.parquet(f"{path}/v{versions[-1]}"), new, keys) if versions else new
    target = f"{path}/v{versions[-1] + 1 if versions else 0}"
    out.write.parquet(target)
    return spark.read.parquet(target)


def latest_runs(events: DataFrame) -> DataFrame:
    """Run log (run_id, at, status, detail) as the latest state of each run with its start."""
    return events.groupBy("run_id").agg(F.min("at").alias("started"), F.max_by("status", "at").alias("status"), F.max("at").alias("changed"))


def evaluated(suggestions: DataFrame, results: DataFrame) -> DataFrame:
    """Suggestions with actual_return and accurate of the results by id."""
    return suggestions.drop("accurate").join(results.select("id", "actual_return", "accurate"), "id", "left")


def pruned(snapshots: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Snapshots that a retention of ``days`` keeps."""
    return snapshots.filter(F.datediff(as_of, "dt") <= days)


def week_ago(snapshots: DataFrame, as_of: str, ages: tuple[int, ...] = (7, 8, 9)) -> DataFrame:
    from tideline.operators.joins import asof_backward

    return asof_backward(snapshots, as_of, min(ages), max(ages))


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON snapshots; files that don't parse are left out."""
    kinds = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    return spark.read.schema(kinds).option("mode", "PERMISSIVE").option("multiLine", True).json(path).filter("_corrupt_record is null").drop("_corrupt_record")
