"""Statistics of samples: corrected moments, quantiles, value at risk, pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normal quantiles: rounded ones of the EWMA rule, exact ones of the Cornish-Fisher rule.
Z95, Z99 = 1.6449, 2.3263
PPF = {0.95: -1.6448536269514722, 0.99: -2.3263478740408408}
YEAR = 252


def corrected_skew(g1: Column, n: Column) -> Column:
    return g1 * F.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def skew(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, corrected_skew(F.skewness(c), n))


def kurtosis(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 3, corrected_kurtosis(F.kurtosis(c), n))


def cornish_fisher(z: Column | float, s: Column, k: Column) -> Column:
    z = F.lit(z) if isinstance(z, float) else z
    return z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36


def sharpe(returns: DataFrame, rf: float = 0.035, by: str = "ticker", least: int = 21) -> DataFrame:
    """(252 mean - rf) / (sqrt(252) sd); null under ``least`` rows or without variation."""
    sd = F.stddev_samp("ret")
    value = F.when((F.count("ret") >= least) & (sd > 0), (YEAR * F.avg("ret") - rf) / (math.sqrt(YEAR) * sd))
    return returns.groupBy(by).agg(value.alias("sharpe"))


def beta(pairs: DataFrame, by: str = "ticker", y: str = "ret", x: str = "bench", least: int = 21) -> DataFrame:
    """Slope of y on x, null under ``least`` rows."""
    return pairs.groupBy(by).agg(F.when(F.count("*") >= least, F.try_divide(F.covar_samp(y, x), F.var_samp(x))).alias("beta"))


def historical_var(returns: DataFrame, levels: tuple[float, ...] = (0.95, 0.99), by: str = "ticker") -> DataFrame:
    """var_<level> as the negative interpolated percentile of returns."""
    return returns.groupBy(by).agg(*[(-F.percentile("ret", F.lit(round(1 - c, 6)))).alias(f"var_{round(c * 100)}") for c in levels])


def cvar(returns: DataFrame, level: float = 0.95, by: str = "ticker") -> DataFrame:
    """Negative mean of the returns at or under the percentile."""
    cut = returns.groupBy(F.col(by).alias("_k")).agg(F.percentile("ret", F.lit(round(1 - level, 6))).alias("_q"))
    return returns.join(cut, F.col(by) == F.col("_k")).filter("ret <= _q").groupBy(by).agg((-F.avg("ret")).alias("cvar"))


def cornish_fisher_var(returns: DataFrame, level: float = 0.95, by: str = "ticker", least: int = 21) -> DataFrame:
    """-z_cf * sd with the corrected skew and kurtosis; null under ``least`` rows."""
    return returns.groupBy(by).agg(F.count("ret").alias("n"), F.stddev_samp("ret").alias("sd"), skew("ret").alias("s"), kurtosis("ret").alias("k")).select(
        by, F.when(F.col("n") >= least, -cornish_fisher(PPF[level], F.col("s"), F.col("k")) * F.col("sd")).alias("var_cf")
    )


def pairs(returns: DataFrame, key: str = "ticker", value: str = "ret") -> DataFrame:
    """(a, b, dt, x, y) for each unordered pair of keys a < b on a date, by a join on the date."""
    left = returns.select(F.col(key).alias("a"), "dt", F.col(value).alias("x"))
    right = returns.select(F.col(key).alias("b"), "dt", F.col(value).alias("y"))
    return left.join(right, "dt").filter("a < b")


def matrix(returns: DataFrame, key: str = "ticker", value: str = "ret") -> DataFrame:
    """(a, b, dt, x, y) for each ordered pair, itself included."""
    left = returns.select(F.col(key).alias("a"), "dt", F.col(value).alias("x"))
    right = returns.select(F.col(key).alias("b"), "dt", F.col(value).alias("y"))
    return left.join(right, "dt")


def covariances(returns: DataFrame) -> DataFrame:
    """a, b, cov (yearly) and corr of each ordered pair over its common dates."""
    return matrix(returns).groupBy("a", "b").agg((F.covar_samp("x", "y") * YEAR).alias("cov"), F.corr("x", "y").alias("corr"))


def ewma_covariances(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    """cov of each ordered pair over dates that all keys have, weights decay^age to a sum of 1, weighted means off."""
    from pyspark.sql import Window as W

    dates = returns.select("dt").distinct().withColumn("age", F.row_number().over(W.orderBy(F.col("dt").desc())) - 1)
    dates = dates.withColumn("w", F.pow(F.lit(decay), F.col("age").cast("double")))
    total = F.sum("w").over(W.partitionBy("a", "b"))
    m = matrix(returns).join(dates, "dt").withColumn("w", F.col("w") / total)
    return m.groupBy("a", "b").agg((F.sum(F.expr("w*x*y")) - F.sum(F.expr("w*x")) * F.sum(F.expr("w*y"))).alias("cov"))


def quadratic_form(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """One row: sigma = sqrt(sum w_a w_b cov_ab)."""
    wa, wb = (weights.select(F.col("ticker").alias(c), F.col("weight").alias(f"w{c}")) for c in ("a", "b"))
    return cov.join(wa, "a").join(wb, "b").agg(F.sqrt(F.sum(F.expr("wa*wb*cov"))).alias("sigma"))


def component_var(weights: DataFrame, cov: DataFrame, z: float = Z95) -> DataFrame:
    """ticker, marginal = z (cov w)_i / sigma, component = w_i marginal, pct of the sum."""
    from pyspark.sql import Window as W

    wb = weights.select(F.col("ticker").alias("b"), F.col("weight").alias("wb"))
    row = cov.join(wb, "b").groupBy("a").agg(F.sum(F.expr("wb*cov")).alias("m")).join(weights.select(F.col("ticker").alias("a"), "weight"), "a")
    every = W.partitionBy()  # one row per ticker of a portfolio
    out = row.withColumn("sigma", F.sqrt(F.sum(F.expr("weight*m")).over(every))).filter("sigma > 0").withColumn("marginal", z * F.col("m") / F.col("sigma"))
    out = out.withColumn("component", F.col("weight") * F.col("marginal"))
    return out.select(F.col("a").alias("ticker"), "weight", "marginal", "component", (F.col("component") / F.sum("component").over(every)).alias("pct"))


def xlogy(x: Column, y: Column) -> Column:
    """x ln y, 0 where y is not positive."""
    return F.when(y > 0, x * F.log(y)).otherwise(0.0)


def coverage_tests(flags: DataFrame, p: float = 0.05, by: str = "ticker") -> DataFrame:
    """Per key of (dt, breach): counts, transitions, likelihood ratios (coverage, independence, both) and p of both."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by).orderBy("dt")
    f = flags.withColumn("b", F.col("breach").cast("int")).withColumn("l", F.lag(F.col("breach").cast("int")).over(w))
    count = lambda a, b: F.count_if((F.col("l") == a) & (F.col("b") == b))
    n = f.groupBy(by).agg(F.count("*").alias("n"), F.sum("b").alias("x"), *[count(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    c = lambda name: F.col(name).cast("double")
    rate = c("x") / c("n")
    lr_uc = -2 * (xlogy(c("n") - c("x"), F.lit(1 - p)) + xlogy(c("x"), F.lit(p)) - xlogy(c("n") - c("x"), 1 - rate) - xlogy(c("x"), rate))
    p01, p11 = F.coalesce(F.try_divide(c("n01"), c("n00") + c("n01")), F.lit(0.0)), F.coalesce(F.try_divide(c("n11"), c("n10") + c("n11")), F.lit(0.0))
    pi = F.coalesce(F.try_divide(c("n01") + c("n11"), c("n00") + c("n01") + c("n10") + c("n11")), F.lit(0.0))
    null = xlogy(c("n00") + c("n10"), 1 - pi) + xlogy(c("n01") + c("n11"), pi)
    free = xlogy(c("n00"), 1 - p01) + xlogy(c("n01"), p01) + xlogy(c("n10"), 1 - p11) + xlogy(c("n11"), p11)
    out = n.withColumn("rate", rate).withColumn("expected", c("n") * p).withColumn("lr_uc", F.greatest(lr_uc, F.lit(0.0))).withColumn("lr_ind", F.greatest(-2 * (null - free), F.lit(0.0)))
    return out.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind")).withColumn("p_cc", F.exp(-F.col("lr_cc") / 2))
