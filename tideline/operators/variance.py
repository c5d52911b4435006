"""Variance models without a loop over rows: the recursion as a scan of affine maps, fits as rounds of likelihood grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Rows of a block of the scan: decays are re-based in each, so nothing overflows for decays of 1e-4 and more.
BLOCK = 64
#: First grid, and how the rounds after it narrow around the best point of the one before.
BETAS, ALPHAS, SHARES = (0.3, 0.5, 0.65, 0.75, 0.82, 0.88, 0.92, 0.95, 0.975), (0.02, 0.05, 0.1, 0.18, 0.3), (0.3, 0.6, 1.0, 1.7, 3.0)
NARROW, ROUNDS = 0.45, 6
LEAST = 60


def scanned(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows(by, t, x, beta)`` with s_t = sum over s < t of beta^(t-1-s) x_s; t counts from 0 and beta is one number per key.

    A row is the map s -> x + beta s. Maps compose to maps, so each block is one map, its end value and its
    length; the blocks' maps are folded in order, and a row adds what its block began with. Keys are scanned
    side by side: a grid of decays is one pass.
    """
    power = lambda e: F.pow("beta", e.cast("double"))
    k = F.col("t") % BLOCK
    inside = W.partitionBy(*by, "_b").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_b", F.floor(F.col("t") / BLOCK)).withColumn("_own", power(k) * F.sum(F.col("x") * power(-k)).over(inside))
    ends = local.groupBy(*by, "_b").agg(F.max_by("_own", "t").alias("end"), F.count("*").alias("n"), F.first("beta").alias("beta"))
    ends = ends.groupBy(*by).agg(F.first("beta").alias("beta"), F.sort_array(F.collect_list(F.struct("_b", "end", "n"))).alias("e"))
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("before"))
    fold = lambda acc, x: F.struct((acc["s"] * F.pow(F.col("beta"), x["n"].cast("double")) + x["end"]).alias("s"), F.concat(acc["before"], F.array(acc["s"])).alias("before"))
    carried = ends.select(*by, F.posexplode(F.aggregate("e", zero, fold)["before"]).alias("_b", "_before"))
    own = F.when(k > 0, F.lag("_own").over(W.partitionBy(*by, "_b").orderBy("t"))).otherwise(0.0)
    return local.join(carried, [*by, "_b"]).withColumn("s", own + F.col("_before") * power(k)).drop("_b", "_own", "_before")


def _level(w: Column, alpha: Column) -> Column:
    """Variance over the mean square, from 1 at t = 0: linear in w and alpha once the scan for beta is there."""
    decay = F.pow("beta", F.col("t").cast("double"))
    return w * (1 - decay) / (1 - F.col("beta")) + decay + alpha * F.col("s")


def losses(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """ticker, beta, alpha, w, loss = sum(ln v + x / v) for each point of ``grid(ticker, j, beta, points array<struct<alpha, w>>)``.

    One scan per beta and one aggregation for all points of it; ``rows(ticker, t, x)``.
    """
    scan = scanned(rows.join(grid.select("ticker", "j", "beta"), "ticker"), ["ticker", "j"])
    size = grid.agg(F.max(F.size("points"))).first()[0] or 1  # 1: no series is long enough
    point = lambda k: F.get("points", F.lit(k))
    joined = scan.join(grid.select("ticker", "j", "points"), ["ticker", "j"])
    value = [F.sum(F.log(v := _level(point(k)["w"], point(k)["alpha"])) + F.col("x") / v).alias(f"l{k}") for k in range(size)]
    sums = joined.groupBy("ticker", "j").agg(*value).select("ticker", "j", F.array(*[f"l{k}" for k in range(size)]).alias("l"))
    out = sums.join(grid, ["ticker", "j"]).select("ticker", "beta", F.explode(F.arrays_zip("points", "l")).alias("p"))
    return out.select("ticker", "beta", "p.points.alpha", "p.points.w", F.col("p.l").alias("loss")).filter("loss is not null")


def _points(alphas: list[Column], ws, beta: str = "beta") -> Column:
    """Admissible (alpha, w): alpha + beta under 0.9999; ``ws`` gives w of alpha."""
    all_ = F.array(*[F.struct(a.alias("alpha"), w.alias("w")) for a in alphas for w in ws(a)])
    return F.filter(all_, lambda p: (p["alpha"] + F.col(beta) < 0.9999) & (p["w"] > 0))


def first_grid(tickers: DataFrame) -> DataFrame:
    """Decays, reactions, and shares of the level that keeps the variance at its mean."""
    betas = tickers.select("ticker", F.posexplode(F.array(*map(F.lit, BETAS))).alias("j", "beta"))
    return betas.withColumn("points", _points([F.lit(a) for a in ALPHAS], lambda a: [(1 - a - F.col("beta")) * s for s in SHARES])).filter(F.size("points") > 0)


def next_grid(best: DataFrame, width: float) -> DataFrame:
    """Seven decays around the best one, five reactions and five levels, all within ``width`` on logarithmic scales."""
    steps = [width * k / 3 for k in range(-3, 4)]
    away = [(1 - F.col("b0")) * F.exp(F.lit(s)) for s in steps]  # 1 - beta is what matters near 1
    betas = best.select("ticker", F.col("alpha").alias("a0"), F.col("w").alias("w0"), F.col("beta").alias("b0"))
    betas = betas.select("ticker", "a0", "w0", F.posexplode(F.array(*[F.greatest(1 - x, F.lit(1e-4)) for x in away])).alias("j", "beta"))
    scale = [width * k / 2 for k in range(-2, 3)]
    points = _points([F.col("a0") * F.exp(F.lit(s)) for s in scale], lambda a: [F.col("w0") * F.exp(F.lit(s)) for s in scale])
    return betas.withColumn("points", points).filter(F.size("points") > 0).select("ticker", "j", "beta", "points")


def _squares(returns: DataFrame, mean: bool) -> DataFrame:
    whole = W.partitionBy("ticker")
    mu = F.avg("ret").over(whole) if mean else F.lit(0.0)
    rows = returns.select("ticker", "dt", "ret").withColumn("mean", mu).withColumn("e", F.col("ret") - F.col("mean"))
    rows = rows.withColumn("var", F.avg(F.col("e") * F.col("e")).over(whole)).withColumn("n", F.count("*").over(whole))
    return rows.withColumn("t", F.row_number().over(whole.orderBy("dt")) - 1).withColumn("x", F.try_divide(F.col("e") * F.col("e"), F.col("var")))


def fit_garch(returns: DataFrame, mean: bool = True) -> DataFrame:
    """ticker, mean, omega, alpha, beta, next_var, ok per series: GARCH(1,1) by maximum likelihood, all series at once.

    Variances start at the mean square. ``ROUNDS`` grids narrow around the best point, each one pass over the
    rows (``losses``). Under ``LEAST`` rows or without variance: 0.05 var, 0.10, 0.85 and not ok. With
    ``mean`` False returns are taken as they are.
    """
    from tideline.plans.scratch import written

    rows = written(_squares(returns, mean), "garch-rows")
    fit = rows.filter((F.col("n") >= LEAST) & (F.col("var") > 1e-16)).select("ticker", "t", "x")
    least = lambda found: found.groupBy("ticker").agg(F.min_by(F.struct("beta", "alpha", "w"), F.struct("loss", "beta", "alpha", "w")).alias("p")).select("ticker", "p.*")
    grid, width = first_grid(fit.select("ticker").distinct()), 0.5
    for _ in range(ROUNDS):
        best = written(least(losses(fit, grid)), "garch-best")
        grid, width = next_grid(best, width), width * NARROW
    all_ = rows.groupBy("ticker").agg(F.first("mean").alias("mean"), F.first("var").alias("var"), F.count("*").alias("n")).join(best, "ticker", "left")
    some = all_.select("ticker", "mean", "var", F.coalesce("w", F.lit(0.05)).alias("w"), F.coalesce("alpha", F.lit(0.10)).alias("alpha"), F.coalesce("beta", F.lit(0.85)).alias("beta"), F.col("w").isNotNull().alias("ok"))
    scan = scanned(rows.select("ticker", "t", "x").fillna(0.0, ["x"]).join(some.select("ticker", "beta"), "ticker"), ["ticker"])
    ends = scan.groupBy("ticker").agg(F.max_by(F.col("x") + F.col("beta") * F.col("s"), "t").alias("s"), F.count("*").alias("t"))
    out = some.join(ends, "ticker")
    return out.select("ticker", "mean", (F.col("w") * F.col("var")).alias("omega"), "alpha", "beta", (_level(F.col("w"), F.col("alpha")) * F.col("var")).alias("next_var"), "ok")


def residuals(returns: DataFrame, fit: DataFrame) -> DataFrame:
    """ticker, dt, z: returns less their mean over the fitted volatility of their row."""
    rows = returns.join(fit.select("ticker", "mean", "omega", "alpha", "beta"), "ticker").withColumn("e", F.col("ret") - F.col("mean"))
    whole = W.partitionBy("ticker")
    rows = rows.withColumn("var", F.avg(F.col("e") * F.col("e")).over(whole)).withColumn("t", F.row_number().over(whole.orderBy("dt")) - 1).withColumn("x", F.coalesce(F.try_divide(F.col("e") * F.col("e"), F.col("var")), F.lit(0.0)))
    scan = scanned(rows, ["ticker"])
    level = _level(F.try_divide("omega", "var"), F.col("alpha"))
    return scan.select("ticker", "dt", (F.col("e") / F.sqrt(F.greatest(level * F.col("var"), F.lit(1e-16)))).alias("z"))


# ---------------------------------------------------------------- correlations


def _pair_losses(points: list[tuple[float, float]], least: int):
    import numpy as np
    import pandas as pd

    a, b = np.array(points).T

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        x, y, none = rows["x"].to_numpy(), rows["y"].to_numpy(), np.full(len(a), np.nan)
        rho = float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() > 0 and y.std() > 0 else np.nan
        out = pd.DataFrame({"a": key[0], "b": key[1], "j": np.arange(len(a)), "rho": rho, "loss": none, "q_xy": none, "q_x": none, "q_y": none})
        if len(x) >= least and np.isfinite(rho):
            qx, qy, qxy, total, rest = np.ones(len(a)), np.ones(len(a)), np.full(len(a), rho), np.zeros(len(a)), 1 - a - b
            for u, v in zip(x.tolist(), y.tolist()):
                r2 = np.clip(qxy * qxy / (qx * qy), 0, 1 - 1e-12)
                r = np.sign(qxy) * np.sqrt(r2)
                total += np.log1p(-r2) + (u * u - 2 * r * u * v + v * v) / (1 - r2)
                qx, qy, qxy = rest + a * u * u + b * qx, rest + a * v * v + b * qy, rest * rho + a * u * v + b * qxy
            out["loss"], out["q_xy"], out["q_x"], out["q_y"] = total, qxy, qx, qy
        return out.astype(object).where(out.notna(), None)

    return run


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by keys over all shuffle partitions: groups are few bytes and much work, which coalescing can't see."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _losses(pairs: DataFrame, points: list[tuple[float, float]], least: int) -> DataFrame:
    """Correlation, loss and last state of each pair at each point; without a loss where the pair doesn't count."""
    return spread(pairs, "a", "b").groupBy("a", "b").applyInPandas(_pair_losses(points, least), "a string, b string, j long, rho double, loss double, q_xy double, q_x double, q_y double")


def _best(losses: DataFrame) -> int | None:
    """The point with the least sum of losses: a row per point on the driver."""
    found = {r["j"]: r["loss"] for r in losses.groupBy("j").agg(F.sum("loss").alias("loss")).collect() if r["loss"] is not None}
    return min(found, key=lambda j: (found[j], j)) if found else None


def fit_correlations(z: DataFrame, least: int = 60) -> DataFrame:
    """a, b, corr, dcc_a, dcc_b, state, level of each ordered pair: dynamic conditional correlations by composite likelihood.

    The likelihood is the sum of all pairs' bivariate ones, so no task holds a panel: a pair's recursion over
    its common dates is one grouped task that follows all points of a grid at once. Two grids: 0.005 to 0.1 by
    0.75 to 0.97, then around the best. corr is the long-run correlation over common dates. Pairs under
    ``least`` dates don't count; with none that does, 0.03 and 0.93. state is the correlation after the last row
    and level the mean of a's own state over its pairs (null for pairs that don't count, and of a with itself).
    """
    from tideline.plans.scratch import written

    x, y = z.select(F.col("ticker").alias("a"), "dt", F.col("z").alias("x")), z.select(F.col("ticker").alias("b"), "dt", F.col("z").alias("y"))
    pairs = written(x.join(y, "dt").filter("a < b"), "dcc-pairs")
    allowed = lambda p: 1e-4 <= p[0] <= 0.2 and 0.7 <= p[1] <= 0.9998 and sum(p) < 0.9999
    best, points = (0.03, 0.93), [(a, b) for a in (0.005, 0.02, 0.05, 0.1) for b in (0.75, 0.85, 0.92, 0.97)]
    if (j := _best(_losses(pairs, points, least))) is not None:
        best = points[j]
    points = [p for m in (0.7, 1, 1.4) for d in (-0.02, 0, 0.015) if allowed(p := (best[0] * m, best[1] + d))]
    each = written(_losses(pairs, points, least), "dcc-losses")
    if (k := _best(each)) is not None:
        best = points[k]
    last = each.filter(F.col("j") == (k or 0))
    state = F.col("q_xy") / F.sqrt(F.col("q_x") * F.col("q_y"))
    one = last.select("a", "b", F.col("rho").alias("corr"), state.alias("state"), F.col("q_x").alias("q"))
    both = one.unionByName(last.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rho").alias("corr"), state.alias("state"), F.col("q_y").alias("q")))
    levels = both.groupBy("a").agg(F.avg("q").alias("level"))
    named = both.join(levels, "a").select("a", "b", "corr", "state", F.when(F.col("state").isNotNull(), F.col("level")).alias("level"))
    none = F.lit(None).cast("double")
    own = z.select("ticker").distinct().select(F.col("ticker").alias("a"), F.col("ticker").alias("b"), F.lit(1.0).alias("corr"), none.alias("state"), none.alias("level"))
    return named.unionByName(own).select("a", "b", "corr", F.lit(best[0]).alias("dcc_a"), F.lit(best[1]).alias("dcc_b"), "state", "level")
