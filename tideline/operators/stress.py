"""Stress scenarios: historical windows, hypothetical shocks, correlation break, liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.joins import lookup

#: Historical scenarios: start, end, and class returns of equity benchmark, bonds and gold where prices lack (fixed values).
HISTORICAL = (
    ("2008 GFC", "2008-09-01", "2009-03-31", -0.56, 0.08, 0.04),
    ("2020 COVID Crash", "2020-02-01", "2020-03-31", -0.34, 0.06, -0.02),
    ("2022 Rate Hikes", "2022-01-01", "2022-10-31", -0.35, -0.17, -0.09),
    ("2000 Dot-com Bust", "2000-03-01", "2002-10-31", -0.49, 0.20, 0.12),
    ("1987 Black Monday", "1987-10-19", "1987-10-19", -0.22, 0.02, 0.01),
)
#: Hypothetical shocks of equity (times beta), bonds and gold (fixed values).
HYPOTHETICAL = (("Rates +200bps", -0.04, -0.12, -0.03), ("USD +15%", -0.08, -0.02, -0.10), ("USD -15%", 0.05, 0.01, 0.08), ("Oil -50%", -0.05, 0.01, -0.02), ("Tech Sector -30%", -0.18, 0.0, 0.0))
GAP = ("Single Pos Gap -40%", -0.40)


def windows_table(spark: SparkSession, rows) -> DataFrame:
    """scenario, start_dt, end_dt; a dozen rows at most."""
    text = [(r[0], r[1], r[2]) for r in rows]
    return spark.createDataFrame(text, "scenario string, s string, e string").select("scenario", F.to_date("s").alias("start_dt"), F.to_date("e").alias("end_dt"))


def in_windows(prices: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of prices in each scenario's window. Windows are spread over their months, so the join has an equal key
    whatever the number of scenarios; a table of a checked size is broadcast.
    """
    months = F.sequence(F.trunc("start_dt", "month"), F.trunc("end_dt", "month"), F.expr("interval 1 month"))
    spread = windows.filter("start_dt <= end_dt").withColumn("_month", F.explode(months))
    near = prices.withColumn("_month", F.trunc("dt", "month")).join(lookup(spread), "_month")
    return near.filter(F.col("dt").between(F.col("start_dt"), F.col("end_dt"))).drop("_month")


def historical(holdings: DataFrame, prices: DataFrame, betas: DataFrame, scenarios=HISTORICAL) -> DataFrame:
    """scenario, pct_loss = sum of weight x return, coverage = weight with prices in the window.

    A holding's return is last/first close - 1 of the window with two closes or more; else its class's, for
    equity and other classes the benchmark's times beta (1 if missing or 0).
    """
    spark = holdings.sparkSession
    named = in_windows(prices, windows_table(spark, scenarios)).groupBy("scenario", "ticker")
    moved = named.agg(F.count("*").alias("n"), (F.max_by("close", "dt") / F.min_by("close", "dt") - 1).alias("actual")).filter("n >= 2")
    shocks = F.array(*[F.struct(F.lit(s[0]).alias("scenario"), F.lit(s[3]).alias("bench"), F.lit(s[4]).alias("bond"), F.lit(s[5]).alias("gold")) for s in scenarios])
    beta = F.coalesce(F.nullif("beta", F.lit(0.0)), F.lit(1.0))
    rows = holdings.join(betas, "ticker", "left").withColumn("s", F.explode(shocks)).withColumn("scenario", F.col("s.scenario"))
    proxy = F.when(F.col("asset_class") == "bond", F.col("s.bond")).when(F.col("asset_class") == "gold", F.col("s.gold")).otherwise(F.col("s.bench") * beta)
    both = rows.join(moved, ["scenario", "ticker"], "left")
    return both.groupBy("scenario").agg(F.sum(F.col("weight") * F.coalesce("actual", proxy)).alias("pct_loss"), F.sum(F.when(F.col("actual").isNotNull(), F.col("weight")).otherwise(0.0)).alias("coverage"))


def class_weights(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("asset_class").agg(F.sum("weight").alias("weight"))


def hypothetical(holdings: DataFrame, beta: float, shocks=HYPOTHETICAL, gap=GAP) -> DataFrame:
    """scenario, pct_loss from class weights, and the gap of the largest position."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(e * beta).alias("equity"), F.lit(b).alias("bond"), F.lit(g).alias("gold")) for n, e, b, g in shocks])
    rows = class_weights(holdings).withColumn("s", F.explode(table))
    hit = F.when(F.col("asset_class") == "equity", F.col("s.equity")).when(F.col("asset_class") == "bond", F.col("s.bond")).when(F.col("asset_class") == "gold", F.col("s.gold")).otherwise(0.0)
    single = holdings.agg((F.max("weight") * gap[1]).alias("pct_loss")).select(F.lit(gap[0]).alias("scenario"), "pct_loss")
    return rows.groupBy("s.scenario").agg(F.sum(F.col("weight") * hit).alias("pct_loss")).unionByName(single)


def everything(hist: DataFrame, hypo: DataFrame) -> DataFrame:
    """kind, scenario, pct_loss of all."""
    a = hist.select(F.lit("historical").alias("kind"), "scenario", "pct_loss")
    return a.unionByName(hypo.select(F.lit("hypothetical").alias("kind"), "scenario", "pct_loss"))


def worst(scenarios: DataFrame, n: int = 3) -> DataFrame:
    return scenarios.orderBy(F.round("pct_loss", 9), "scenario").limit(n)


def correlation_break(weights: DataFrame, cov: DataFrame, rho: float = 0.85) -> DataFrame:
    """One row: sigma as measured, with all correlations at rho, and their ratio."""
    var = cov.filter("a = b").select("a", F.sqrt("cov").alias("s"))
    wa, wb = (weights.join(var, F.col("ticker") == F.col("a")).select(F.col("ticker").alias(c), F.col("weight").alias(f"w{c}"), F.col("s").alias(f"s{c}")) for c in ("a", "b"))
    rows = cov.join(wa, "a").join(wb, "b")
    broken = F.when(F.col("a") == F.col("b"), F.expr("wa*wb*sa*sb")).otherwise(F.expr("wa*wb*sa*sb") * rho)
    out = rows.agg(F.sqrt(F.sum(F.expr("wa*wb*cov"))).alias("sigma"), F.sqrt(F.sum(broken)).alias("sigma_break"))
    return out.withColumn("ratio", F.try_divide("sigma_break", "sigma"))


def illiquid(positions: DataFrame, bars: DataFrame, days: int = 3, times: float = 5.0) -> DataFrame:
    """Positions of more than ``times`` the mean volume of the last ``days`` rows."""
    from tideline.operators.series import tail

    adv = tail(bars, days).groupBy("ticker").agg(F.avg("volume").alias("adv"))
    return positions.join(adv, "ticker").filter(F.col("quantity") > times * F.col("adv"))
