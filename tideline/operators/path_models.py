"""Models of simulated paths, fitted where the rows are: a grouped task per series, one per pair, sums for the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.kernels import fits
from tideline.kernels.paths import Model, psd
from tideline.operators import moments as M
from tideline.operators import series as X
from tideline.operators.variance import fit_correlations, spread

_PARAMS = ("mean", "omega", "alpha", "beta", "next_var", "base", "excite", "jump_mean", "jump_sd")


def series_fits(returns: DataFrame) -> DataFrame:
    """ticker, dt, z and the series' parameters on each of its rows: variance recursion and jumps of one series a task.

    z is the residual over the fitted volatility; base, excite, jump_mean and jump_sd are those of clustered
    jumps beyond two smoothed volatilities. Rows without a finite return are left out. A series under 60 rows
    has the fallbacks of ``fits.garch``.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        r = rows["ret"].to_numpy()
        fit = fits.garch(r)
        smooth = fits._recursion(r**2, 0.0, 0.06, 0.94, float(r.var(ddof=1)) if len(r) > 1 else 0.0)[:-1]
        jump = fits.hawkes(r, np.sqrt(np.maximum(smooth, 1e-16)))
        values = {k: fit[k] for k in _PARAMS[:5]} | {"base": jump["base"], "excite": jump["excite"], "jump_mean": jump["mean"], "jump_sd": jump["sd"]}
        return pd.DataFrame({"ticker": rows["ticker"], "dt": rows["dt"], "z": fit["resid"], **values})

    whole = returns.filter(F.col("ret").isNotNull() & ~F.isnan("ret")).select("ticker", "dt", "ret")
    return spread(whole, "ticker").groupBy("ticker").applyInPandas(run, "ticker string, dt date, z double, " + ", ".join(f"{p} double" for p in _PARAMS))


def path_model(returns: DataFrame) -> tuple[list[str], Model]:
    """Names and simulation model of the assets of ``returns(ticker, dt, ret)``.

    The driver gets a row per asset and one per pair, which every simulating task needs whole; dates stay in
    tables. Correlations and their state are those of ``fit_correlations``; residuals is a table (dt, z) of the
    dates on which all assets have a row, z in the order of the names.
    """
    from tideline.plans.scratch import written

    rows = written(series_fits(returns), "path-fits")
    fit = rows.groupBy("ticker").agg(*[F.first(p).alias(p) for p in _PARAMS]).orderBy("ticker").collect()
    names = [r["ticker"] for r in fit]
    at, n = {t: k for k, t in enumerate(names)}, len(names)
    corr, level, shape, ab = np.eye(n), np.ones(n), np.eye(n), (0.03, 0.93)
    for r in fit_correlations(rows.select("ticker", "dt", "z")).collect():
        i, j = at[r["a"]], at[r["b"]]
        ab = r["dcc_a"], r["dcc_b"]
        corr[i, j] = 1.0 if i == j else r["corr"] or 0.0
        if i != j:
            shape[i, j] = corr[i, j] if r["state"] is None else r["state"]
            level[i] = 1.0 if r["level"] is None else r["level"]
    of = lambda k: np.array([r[k] for r in fit], float)
    jumps = {"base": 0.5 * of("base"), "excite": of("excite"), "mean": of("jump_mean"), "sd": of("jump_sd"), "decay": 0.5}
    full = rows.groupBy("dt").agg(F.sort_array(F.collect_list(F.struct("ticker", "z"))).alias("v")).filter(F.size("v") == n).select("dt", F.expr("transform(v, x -> x.z)").alias("z"))
    start = psd(shape * np.sqrt(np.outer(level, level)))
    return names, Model(of("mean"), of("omega"), of("alpha"), of("beta"), of("next_var"), psd(corr), ab, full, jumps, start)


def sample_model(returns: DataFrame, window: int = 63) -> tuple[list[str], Model]:
    """Names and a model of zero mean with the sample covariance of the last ``window`` rows of each asset."""
    cov = M.covariances(X.tail(returns, window)).collect()  # a row per pair of assets
    names = sorted({r["a"] for r in cov})
    at, n = {t: k for k, t in enumerate(names)}, len(names)
    m = np.zeros((n, n))
    for r in cov:
        m[at[r["a"]], at[r["b"]]] = (r["cov"] or 0.0) / 252
    var, none = np.maximum(np.diag(m), 1e-16), np.zeros(n)
    return names, Model(none, none, none, none, var, psd(m + 1e-8 * np.diag(var)) / np.sqrt(np.outer(var, var)), residuals=None)
