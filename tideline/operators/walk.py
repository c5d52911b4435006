"""Walk-forward windows, out-of-sample metrics, rule back-tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.operators import series as X


def oos_metrics(returns: DataFrame, rf: float = 0.035) -> DataFrame:
    """Yearly return and volatility (population), Sharpe (0 without volatility) and largest drawdown per ticker."""
    vol = math.sqrt(252) * F.stddev_pop("ret")
    mean = 252 * F.avg("ret")
    return X.drawdown(returns).groupBy("ticker").agg(mean.alias("ann_ret"), vol.alias("ann_vol"), F.when(vol > 1e-9, (mean - rf) / vol).otherwise(0.0).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))


def summary(windows: DataFrame, a: str, b: str) -> DataFrame:
    """Means over windows, the mean difference and how often a beats b."""
    gain = F.col(a) - F.col(b)
    return windows.agg(F.count("*").alias("windows"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(gain).alias("delta"), F.avg((gain > 0).cast("int")).alias("win_rate"))


def eval_grid(returns: DataFrame, train: int, forward: int, periods: int) -> DataFrame:
    """Evaluation rows (ticker, dt, rn) of the reference calendar, the first ticker's: every ``forward`` rows from the end."""
    first = returns.agg(F.min("ticker").alias("_t"))
    rows = returns.join(F.broadcast(first), F.col("ticker") == F.col("_t"))  # one row
    n = F.count("*").over(X.whole())
    left = n - F.row_number().over(X.by()) + 1
    grid = rows.withColumn("rn", F.row_number().over(X.by())).withColumn("_left", left)
    return grid.filter((F.col("_left") % forward == 0) & F.floor(F.col("_left") / forward).between(1, periods) & (F.col("rn") > train)).select("ticker", "dt", "rn")


def crossover_backtest(bars: DataFrame, cash: float = 10_000.0, least: int = 60) -> DataFrame:
    """A moving-average crossover per ticker: bought at an entry's close, sold at an exit's, without fees.

    ann_ret, sharpe (no risk-free rate), max_drawdown, trades and win_rate; tickers under ``least`` rows are left out.
    """
    flags = X.crossings(bars).withColumn("_c", F.count("*").over(X.whole())).filter(F.col("_c") >= least)
    state = F.last(F.when(F.col("entry"), 1).when(F.col("exit"), 0), ignorenulls=True).over(X.rows(W.unboundedPreceding))
    held = flags.withColumn("_in", F.coalesce(state, F.lit(0))).withColumn("_was", F.coalesce(F.lag("_in").over(X.by()), F.lit(0)))
    step = F.when(F.col("_was") == 1, F.col("close") / F.lag("close").over(X.by()) - 1).otherwise(0.0)
    run = held.withColumn("ret", step).withColumn("_trade", F.sum(F.when((F.col("_in") == 1) & (F.col("_was") == 0), 1).otherwise(0)).over(X.rows(W.unboundedPreceding)))
    trades = run.filter("_was = 1").groupBy("ticker", "_trade").agg(F.sum(F.log1p("ret")).alias("g"))
    won = trades.groupBy("ticker").agg(F.count("*").alias("trades"), F.avg((F.col("g") > 0).cast("int")).alias("win_rate"))
    whole = X.drawdown(run).groupBy("ticker").agg((252 * F.avg("ret")).alias("ann_ret"), F.try_divide(math.sqrt(252) * F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), (cash * F.max_by("cum", "dt")).alias("equity"))
    return whole.join(won, "ticker", "left")
