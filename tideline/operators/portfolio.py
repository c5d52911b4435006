"""Holdings, weights, classification, data quality and set logic of portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.operators.joins import lookup

DEFAULT_FX = {"USD": 0.92, "GBP": 1.17, "AUD": 0.59, "EUR": 1.0}
#: Broker tickers that trade under another one, and names of instruments.
REMAP = {"YNDX": "NBIS"}
INSTRUMENTS = {"MAG-7": "MAGS", "GOLD": "GLD"}


def every() -> W:
    return W.partitionBy()


def to_eur(holdings: DataFrame, fx: DataFrame) -> DataFrame:
    """market_value_eur and cost_basis_eur at the currency's rate; a currency without rate has its default."""
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_FX.items() for x in kv])
    rate = F.coalesce("rate_eur", default[F.col("currency")], F.lit(1.0))
    out = holdings.join(lookup(fx), "currency", "left").withColumn("rate_eur", rate)
    return out.withColumn("market_value_eur", F.col("mv_native") * F.col("rate_eur")).withColumn("cost_basis_eur", F.col("cost_native") * F.col("rate_eur"))


def with_weight(holdings: DataFrame) -> DataFrame:
    """weight = value / total value, 0 if the total is 0."""
    return holdings.withColumn("weight", F.coalesce(F.try_divide("market_value_eur", F.sum("market_value_eur").over(every())), F.lit(0.0)))


def by_ticker(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("ticker").agg(F.sum("weight").alias("weight"))


def value_by_ticker(holdings: DataFrame, order: str = "platform") -> DataFrame:
    """Summed value, and class and currency of the first holding record."""
    return holdings.groupBy("ticker").agg(F.sum("market_value_eur").alias("market_value_eur"), F.min_by("asset_class", order).alias("asset_class"), F.min_by("currency", order).alias("currency"))


def nav(holdings: DataFrame) -> DataFrame:
    """One row: nav, cost, pnl, bond value and share."""
    bond = F.sum(F.when(F.col("asset_class") == "bond", F.col("market_value_eur")).otherwise(0.0))
    total = F.sum("market_value_eur")
    return holdings.agg(total.alias("nav_eur"), F.sum("cost_basis_eur").alias("cost_eur"), (total - F.sum("cost_basis_eur")).alias("pnl_eur"), bond.alias("bond_eur"), F.coalesce(F.try_divide(bond, total), F.lit(0.0)).alias("bond_pct"))


def pnl_pct(holdings: DataFrame) -> DataFrame:
    gain = F.col("market_value_eur") - F.col("cost_basis_eur")
    return holdings.withColumn("pnl_eur", gain).withColumn("pnl_pct", F.coalesce(F.try_divide(gain, F.col("cost_basis_eur")), F.lit(0.0)))


def concentration(holdings: DataFrame) -> DataFrame:
    """hhi and largest weight per holding row."""
    return holdings.agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.max("weight").alias("max_position"))


def classify_series(prices: DataFrame, target: int = 252, least: int = 21) -> DataFrame:
    """ticker, days, status (unavailable, excluded, reduced, ok) and flag."""
    n = F.count("close")
    status = F.when(n == 0, "unavailable").when(n < least, "excluded").when(n < target, "reduced").otherwise("ok")
    flag = F.when((n >= least) & (n < target), F.concat(F.lit("["), n.cast("string"), F.lit("d window]"))).otherwise("")
    return prices.groupBy("ticker").agg(F.least(n, F.lit(target)).cast("long").alias("days"), status.alias("status"), flag.alias("flag"))


def signal(t: Column) -> Column:
    return F.when(t > 1.5, "BUY").when(t < -1.5, "SELL").otherwise("HOLD")


def stars(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a >= 3, "★★★").when(a >= 2, "★★").when(a >= 1.5, "★").otherwise("")


def traffic_light(value: Column, breach: Column) -> Column:
    return F.when(value.isNull(), "GREY").when(breach, "RED").otherwise("GREEN")


def tier(delta: Column, cgt: Column) -> Column:
    """3 under 2 %; 2 with a tax flag or under 5 %; else 1."""
    return F.when(F.abs(delta) < 0.02, 3).when(cgt | (F.abs(delta) < 0.05), 2).otherwise(1)


def equity_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("asset_class", F.lit("equity")) == "equity")


def remap(rows: DataFrame, mapping: dict[str, str] = REMAP) -> DataFrame:
    """Tickers replaced; a description follows only where it was the old ticker."""
    new = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("ticker")]
    same = (F.col("description") == F.col("ticker")) & new.isNotNull()
    return rows.withColumn("description", F.when(same, new).otherwise(F.col("description"))).withColumn("ticker", F.coalesce(new, "ticker"))


def gaps(prices: DataFrame, allowed: float = 10) -> DataFrame:
    """Tickers with more than ``allowed`` rows fewer than 5/7 of their calendar span."""
    span = F.datediff(F.max("dt"), F.min("dt"))
    out = prices.groupBy("ticker").agg(F.count("*").alias("rows"), (span * 5 / 7.0).alias("expected"))
    return out.withColumn("missing", F.col("expected") - F.col("rows")).filter(F.col("missing") > allowed)


def spikes(returns: DataFrame, limit: float = 0.5) -> DataFrame:
    return returns.filter(F.abs("ret") > limit)


def stale(prices: DataFrame, as_of: Column | None = None, days: int = 4) -> DataFrame:
    """Tickers whose last row is more than ``days`` before as_of (default: the last date of all)."""
    last = prices.groupBy("ticker").agg(F.max("dt").alias("last_dt"))
    seen = last.withColumn("as_of", F.max("last_dt").over(every()) if as_of is None else as_of)
    return seen.withColumn("age", F.datediff("as_of", "last_dt")).filter(F.col("age") > days)


def market_hours(bars: DataFrame) -> DataFrame:
    """Rows on weekdays between 14:30 and 21:00 inclusive."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    return bars.filter(F.dayofweek("ts").between(2, 6) & minute.between(14 * 60 + 30, 21 * 60))


def new_alerts(alerts: DataFrame, log: DataFrame, hours: int = 24) -> DataFrame:
    """Alerts whose key wasn't fired within the hours before."""
    recent = log.select(F.col("key").alias("_key"), F.col("fired_at").alias("_at"))
    near = (F.col("key") == F.col("_key")) & (F.col("_at") <= F.col("fired_at")) & (F.col("_at") > F.col("fired_at") - F.expr(f"interval {hours} hours"))
    return alerts.join(recent, near, "left_anti")
