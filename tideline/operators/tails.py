"""Tails of losses: generalised Pareto fits of all series at once, by aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Grid of theta, the profile's parameter: below 0 in units of 1 / mean (geometric), above 0 in units of 1 / largest excess (towards 1).
BELOW = [-1e-4 * (20 / 1e-4) ** (k / 159) for k in range(160)]
ABOVE = [1 - 0.9999 * (1e-6 / 0.9999) ** (k / 79) for k in range(80)]
#: Points between the best one's neighbours in a round, and rounds.
FINER, ROUNDS = 20, 3


def excesses(returns: DataFrame, tail: float = 0.10) -> DataFrame:
    """ticker, u, x: losses over their (1 - tail) quantile u, less u; n and the 99 % loss beside. Series under 60 rows are left out."""
    loss = returns.select("ticker", (-F.col("ret")).alias("loss"))
    cut = loss.groupBy("ticker").agg(F.count("*").alias("n"), F.percentile("loss", F.lit(1 - tail)).alias("u"), F.percentile("loss", F.lit(0.99)).alias("plain")).filter("n >= 60")
    return loss.join(cut, "ticker").filter("loss > u").select("ticker", "u", "plain", (F.col("loss") - F.col("u")).alias("x"))


def _profiled(x: DataFrame, grid: DataFrame) -> DataFrame:
    """ticker, g, theta, shape, loss: n ln(-shape / theta) + n (shape + 1), shape = mean ln(1 - theta x), where it is allowed."""
    k = F.avg(F.log1p(-F.col("theta") * F.col("x")))
    sums = x.select("ticker", "x").join(grid, "ticker").groupBy("ticker", "g", "theta").agg(F.count("*").alias("n"), k.alias("shape"))
    return sums.filter("-shape / theta > 0 and shape > -1").withColumn("loss", F.col("n") * F.log(-F.col("shape") / F.col("theta")) + F.col("n") * (F.col("shape") + 1))


def pareto_fits(x: DataFrame) -> DataFrame:
    """ticker, theta, shape, scale of the excesses of every series, by the profile likelihood in theta = -shape / scale.

    A grid of 240 points, then rounds of ``FINER`` steps between the best point's neighbours; a round is one
    join of the excesses with a small grid and one partial aggregation.
    """
    units = F.array(*[F.lit(v) / F.col("mean") for v in BELOW], *[F.lit(v) / F.col("top") for v in ABOVE])
    grid = x.groupBy("ticker").agg(F.avg("x").alias("mean"), F.max("x").alias("top")).select("ticker", F.array_sort(units).alias("all"))
    for r in range(ROUNDS + 1):
        points = grid.select("ticker", F.posexplode("all").alias("g", "theta")).filter("theta <> 0")
        best = _profiled(x, points).groupBy("ticker").agg(F.min_by(F.struct("g", "theta", "shape"), F.struct("loss", "g")).alias("p"))
        near = best.join(grid, "ticker")
        low, high = F.get("all", F.greatest(F.col("p.g") - 1, F.lit(0))), F.get("all", F.least(F.col("p.g") + 1, F.size("all") - 1))
        if r < ROUNDS:
            grid = near.select("ticker", F.transform(F.sequence(F.lit(0), F.lit(FINER)), lambda k: low + (high - low) * k / float(FINER)).alias("all"))
    return best.select("ticker", "p.theta", "p.shape", (-F.col("p.shape") / F.col("p.theta")).alias("scale"))


def tail_var(returns: DataFrame, level: float = 0.99, tail: float = 0.10, least: int = 20) -> DataFrame:
    """ticker, var_evt: value at risk by peaks over threshold; the historical one with fewer than ``least`` excesses.

    Every series with 60 rows or more has a row.
    """
    from tideline.plans.scratch import written

    x = written(excesses(returns, tail), "excesses")
    n = x.groupBy("ticker").agg(F.count("*").alias("m"), F.first("u").alias("u"), F.first("plain").alias("plain"))
    fit = pareto_fits(x.withColumn("m", F.count("*").over(W.partitionBy("ticker"))).filter(F.col("m") >= least))
    p = (1 - level) / tail
    k, s = F.col("shape"), F.col("scale")
    far = F.when(F.abs(k) < 1e-6, F.col("u") - s * math.log(p)).otherwise(F.col("u") + s / k * (F.pow(F.lit(p), -k) - 1))
    return n.join(fit, "ticker", "left").select("ticker", F.when(F.col("m") < least, F.col("plain")).otherwise(far).alias("var_evt"))
