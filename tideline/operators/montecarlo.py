"""Simulated paths in blocks, and path statistics as aggregations."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tideline.kernels.paths import Model, simulate

BLOCK = 2000
#: Cells of a block's correlation matrices (paths x assets x assets) at most.
CELLS = 5_000_000


def _blocks(spark: SparkSession, model: Model, weights: np.ndarray, paths: int, steps: int, kind: str, seed: int, rows, schema: str) -> DataFrame:
    """``rows`` (first path, returns by path and step) of blocks of paths, each simulated from its own seed.

    Blocks are dealt to tasks; where paths draw residuals, their table (dt, z) is sent to each task by a shuffle.
    """
    size = max(1, min(BLOCK, CELLS // max(1, len(weights)) ** 2))
    blocks = -(-paths // size)
    tasks = min(blocks, max(1, spark.sparkContext.defaultParallelism))
    drawn, bare = model.residuals if kind == "hawkes" else None, replace(model, residuals=None)

    def block(b: int, residuals: np.ndarray | None) -> pd.DataFrame:
        own = replace(bare, residuals=residuals)
        return rows(b * size, simulate(own, min(size, paths - b * size), steps, kind, np.random.Generator(np.random.PCG64([seed, b]))) @ weights)

    if not isinstance(drawn, DataFrame):

        def run(frames):
            for frame in frames:
                for b in frame["id"].tolist():
                    yield block(b, drawn)

        return spark.range(0, blocks, 1, tasks).mapInPandas(run, schema)

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        z = frame[frame["z"].notna()].sort_values("dt")["z"]
        residuals = np.stack(z.tolist()) if len(z) else None
        return pd.concat([block(b, residuals) for b in range(key[0], blocks, tasks)])

    every = drawn.select("dt", "z", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    empty = spark.range(tasks).select(F.lit(None).cast("date").alias("dt"), F.lit(None).cast("array<double>").alias("z"), F.col("id").cast("int").alias("task"))
    return every.unionByName(empty).repartition(tasks, "task").groupBy("task").applyInPandas(task, schema)


def simulate_portfolio(spark: SparkSession, model: Model, weights: np.ndarray, paths: int = 50_000, steps: int = 21, kind: str = "hawkes", seed: int = 42) -> DataFrame:
    """(path, step, ret) of a constant-mix portfolio: blocks of paths are simulated apart, each from its own seed.

    The model is a few vectors and matrices over the assets; a task holds a block's tensor, and the residuals it draws.
    """

    def rows(first: int, r: np.ndarray) -> pd.DataFrame:
        n = len(r)
        return pd.DataFrame({"path": np.repeat(np.arange(first, first + n), steps), "step": np.tile(np.arange(1, steps + 1), n), "ret": r.ravel()})

    return _blocks(spark, model, weights, paths, steps, kind, seed, rows, "path long, step long, ret double")


def simulated_ends(spark: SparkSession, model: Model, weights: np.ndarray, paths: int = 50_000, steps: int = 21, kind: str = "hawkes", seed: int = 42) -> DataFrame:
    """What ``path_ends`` says of the same paths, taken in their blocks: a row per path and no shuffle."""

    def rows(first: int, r: np.ndarray) -> pd.DataFrame:
        nav = np.exp(np.cumsum(np.log1p(np.maximum(r, -0.999999)), axis=1))
        peak = np.maximum.accumulate(np.maximum(nav, 1.0), axis=1)
        down = np.sqrt((np.minimum(r, 0.0) ** 2).mean(1))
        return pd.DataFrame({"path": np.arange(first, first + len(r)), "total": nav[:, -1] - 1, "drawdown": (nav / peak - 1).min(1), "m": r.mean(1), "s": r.std(1), "down": down})

    return _blocks(spark, model, weights, paths, steps, kind, seed, rows, "path long, total double, drawdown double, m double, s double, down double")


def nav_paths(paths: DataFrame) -> DataFrame:
    """nav of each step from 1 at the start."""
    w = W.partitionBy("path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return paths.withColumn("nav", F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(w)))


def path_drawdown(nav: DataFrame) -> DataFrame:
    """Largest fall of each path from its peak, the start included."""
    w = W.partitionBy("path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    peak = F.greatest(F.max("nav").over(w), F.lit(1.0))
    return nav.withColumn("d", F.col("nav") / peak - 1).groupBy("path").agg(F.min("d").alias("drawdown"))


def path_ends(nav: DataFrame) -> DataFrame:
    """Per path: total return, largest drawdown, mean, deviation and downside deviation of its steps."""
    w = W.partitionBy("path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    fall = nav.withColumn("d", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    r = F.col("ret")
    return fall.groupBy("path").agg((F.max_by("nav", "step") - 1).alias("total"), F.min("d").alias("drawdown"), F.avg(r).alias("m"), F.stddev_pop(r).alias("s"), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("down"))


def tail_metrics(ends: DataFrame) -> DataFrame:
    """One row: VaR and CVaR of the end value at 95 and 99 %, expected loss, loss chances, drawdown mean and 95 %."""
    cuts = ends.agg(F.percentile("total", F.lit(0.05)).alias("q05"), F.percentile("total", F.lit(0.01)).alias("q01"))
    t = F.col("total")
    rows = ends.join(F.broadcast(cuts))  # one row
    chance = lambda x: F.avg((t < -x).cast("int"))
    return rows.agg(
        (-F.first("q05")).alias("var_95"), (-F.first("q01")).alias("var_99"), (-F.avg(F.when(t <= F.col("q05"), t))).alias("cvar_95"), (-F.avg(F.when(t <= F.col("q01"), t))).alias("cvar_99"),
        (-F.avg(F.when(t < 0, t))).alias("expected_loss"), chance(0.05).alias("p_loss_5"), chance(0.10).alias("p_loss_10"), chance(0.20).alias("p_loss_20"), F.avg("drawdown").alias("dd_mean"), F.percentile("drawdown", F.lit(0.05)).alias("dd_95"),
    )


def decision_metrics(ends: DataFrame) -> DataFrame:
    """One row: medians and tenths of per-path Sharpe, Sortino and Calmar ratios (population moments), share of winners."""
    root = math.sqrt(252)
    ratio = lambda a, b, n: F.try_divide(a, F.nullif(b, F.lit(0.0))).alias(n)
    m = F.col("m")
    per = ends.select(ratio(m * root, F.col("s"), "sharpe"), ratio(m * root, F.col("down"), "sortino"), ratio(m * 252, -F.col("drawdown"), "calmar"), "total")
    cut = lambda c, p, n: F.percentile(c, F.lit(p)).alias(n)
    return per.agg(cut("sharpe", 0.5, "sharpe_median"), cut("sharpe", 0.1, "sharpe_p10"), cut("sortino", 0.5, "sortino_median"), cut("calmar", 0.5, "calmar_median"), F.avg((F.col("total") > 0).cast("int")).alias("win_rate"))
