"""Factor regressions from distributed sufficient statistics, and what is derived from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators.joins import lookup
from tideline.operators.series import tail

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")
LEAST_ROWS, YEAR = 63, 252


def gram(rows: DataFrame, factors: tuple[str, ...] = FACTORS, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """n, means and centred cross sums of y and the factors per key: one partial aggregation.

    Covariances are aggregated by Spark's stable update formulas, so nothing cancels.
    """
    names = ("y", *factors)
    moments = [F.covar_pop(a, b).alias(f"c_{a}_{b}") for k, a in enumerate(names) for b in names[k:]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *moments)


def _solve(factors: tuple[str, ...], least: int):
    names = ("y", *factors)
    keep = ["n", "alpha", "se_alpha", "t_alpha", "ir", "r2", "sigma", *[f"{p}_{f}" for f in factors for p in ("beta", "se", "t")]]

    def run(frames):
        for frame in frames:
            out = {c: np.full(len(frame), np.nan) for c in keep}
            out["n"] = frame["n"].to_numpy(float)
            for i, r in enumerate(frame.to_dict("records")):
                n, k = int(r["n"]), len(factors)
                if n < max(least, k + 2):
                    continue
                c = np.array([[r[f"c_{names[min(a, b)]}_{names[max(a, b)]}"] for b in range(k + 1)] for a in range(k + 1)], float) * n
                xx, xy, yy = c[1:, 1:], c[1:, 0], c[0, 0]
                scale = np.sqrt(np.diag(xx))
                if (scale <= 0).any() or np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-10) < k:
                    continue
                inv = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
                beta = inv @ xy
                m = np.array([r[f"m_{f}"] for f in factors])
                alpha, rss = r["m_y"] - beta @ m, max(yy - beta @ xy, 0.0)
                s2 = rss / (n - k - 1)
                se, se_a = np.sqrt(np.maximum(s2 * np.diag(inv), 0)), math.sqrt(max(s2 * (1 / n + m @ inv @ m), 0))
                sigma = math.sqrt(rss / (n - 1))
                out["alpha"][i], out["se_alpha"][i], out["sigma"][i] = alpha, se_a, sigma
                out["t_alpha"][i] = alpha / se_a if se_a > 1e-12 else np.nan
                out["ir"][i] = alpha / sigma * math.sqrt(YEAR) if sigma > 1e-12 else np.nan
                out["r2"][i] = 1 - rss / yy if yy > 1e-12 else 0.0
                for j, f in enumerate(factors):
                    out[f"beta_{f}"][i], out[f"se_{f}"][i] = beta[j], se[j]
                    out[f"t_{f}"][i] = beta[j] / se[j] if se[j] > 1e-12 else np.nan
            keys = [c for c in frame.columns if c != "n" and c[:2] not in ("m_", "c_")]
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    return run, keep


def regress(rows: DataFrame, factors: tuple[str, ...] = FACTORS, by: tuple[str, ...] = ("ticker",), least: int = LEAST_ROWS) -> DataFrame:
    """OLS of y on the factors per key: alpha, betas, standard errors, t, r2, ir, sigma (null under ``least`` rows).

    Only Gram matrices, a row per key, reach Python; the rows stay in a partial aggregation.
    """
    stats = gram(rows, factors, by)
    run, keep = _solve(factors, least)
    kinds = dict(stats.dtypes)
    schema = ", ".join([f"`{b}` {kinds[b]}" for b in by] + [f"{c} double" for c in keep])
    out = stats.mapInPandas(run, schema)
    return out.select(*by, F.col("n").cast("long").alias("n"), *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in keep[1:]])


def factor_regression(aligned: DataFrame, factors: tuple[str, ...] = FACTORS, window: int = YEAR, least: int = LEAST_ROWS) -> DataFrame:
    """The regression of the last ``window`` aligned rows, with alpha_ann and signal."""
    from tideline.operators.portfolio import signal, stars

    out = regress(tail(aligned, window), factors, least=least)
    return out.withColumn("alpha_ann", F.col("alpha") * YEAR).withColumn("signal", signal(F.col("t_alpha"))).withColumn("stars", stars(F.coalesce("t_alpha", F.lit(0.0))))


def single_factor(rows: DataFrame, x: str = "mkt_rf", least: int = LEAST_ROWS) -> DataFrame:
    """alpha, beta, r2 and t of a one-factor regression by built-in aggregates."""
    n = F.count("*")
    rss = F.regr_syy("y", x) - F.pow(F.regr_sxy("y", x), 2) / F.regr_sxx("y", x)
    s = F.sqrt(F.greatest(rss, F.lit(0.0)) / (n - 2))
    agg = rows.groupBy("ticker").agg(n.alias("n"), F.regr_intercept("y", x).alias("alpha"), F.regr_slope("y", x).alias("beta"), F.regr_r2("y", x).alias("r2"), (s / F.sqrt(F.regr_sxx("y", x))).alias("se"))
    return agg.filter(F.col("n") >= least).withColumn("t_beta", S.t_stat("beta", "se"))


def style_labels(betas: DataFrame, bounds: DataFrame) -> DataFrame:
    """(ticker, factor, beta) with the style that a beta outside its factor's bounds has."""
    joined = betas.join(lookup(bounds), "factor")
    return joined.withColumn("style", F.when(F.col("beta") > F.col("hi"), F.col("above")).when(F.col("beta") < F.col("lo"), F.col("below")).otherwise("neutral"))


def portfolio_exposure(regressions: DataFrame, weights: DataFrame, columns: tuple[str, ...], errors: tuple[str, ...] = ()) -> DataFrame:
    """Weighted means of regression columns over holdings with a regression, and pooled standard errors."""
    joined = weights.join(regressions, "ticker").filter(F.col(columns[0]).isNotNull())
    used = F.sum("weight")
    means = [F.try_divide(F.sum(F.col("weight") * F.col(c)), used).alias(c) for c in columns]
    pooled = [F.try_divide(F.sqrt(F.sum(F.pow(F.col("weight") * F.col(c), 2))), used).alias(c) for c in errors]
    return joined.agg(used.alias("used"), *means, *pooled)


def attribution(rows: DataFrame, betas: DataFrame, factors: tuple[str, ...], window: int = 21, least: int = 5) -> DataFrame:
    """ticker, factor, beta, factor_ret, contrib and pct of the total over the last ``window`` rows; totals repeat.

    alpha = total - rf - sum of contributions.
    """
    sums = tail(rows, window).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("ret").alias("total"), F.sum("rf").alias("rf_sum"), *[F.sum(f).alias(f) for f in factors]).filter(F.col("n") >= least)
    long = sums.unpivot(["ticker", "n", "total", "rf_sum"], list(factors), "factor", "factor_ret")
    joined = long.join(betas.unpivot(["ticker"], [c for c in betas.columns if c != "ticker"], "factor", "beta"), ["ticker", "factor"])
    out = joined.withColumn("contrib", F.col("beta") * F.col("factor_ret"))
    explained = F.sum("contrib").over(W.partitionBy("ticker"))
    out = out.withColumn("alpha", F.col("total") - F.col("rf_sum") - explained)
    return out.withColumn("pct_of_total", F.when(F.abs("total") > 1e-10, F.col("contrib") / F.col("total"))).select("ticker", "factor", "beta", "factor_ret", "contrib", "pct_of_total", "total", "alpha")


def dominant(attributed: DataFrame) -> DataFrame:
    return attributed.groupBy("ticker").agg(F.max_by("factor", F.struct(F.round(F.abs("pct_of_total"), 9), "factor")).alias("dominant"), F.first("alpha").alias("alpha"))


def drivers(attributed: DataFrame, k: int = 3, least: float = 0.05) -> DataFrame:
    """Up to k factors per ticker with at least 5 % of the total, the largest first."""
    w = W.partitionBy("ticker").orderBy(F.round(F.abs("pct_of_total"), 9).desc(), "factor")
    return attributed.filter(F.abs("pct_of_total") >= least).withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def driver_text(top: DataFrame) -> DataFrame:
    part = F.concat(F.upper("factor"), F.lit(" "), F.format_string("%+.0f%%", F.col("pct_of_total") * 100))
    parts = top.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("place", part.alias("p")))).alias("s"))
    return parts.select("ticker", F.array_join(F.transform("s", lambda x: x["p"]), " · ").alias("text"))


def vif(factors_table: DataFrame, names: tuple[str, ...] = FACTORS) -> DataFrame:
    """factor, vif: the diagonal of the inverse correlation matrix, infinite where R2 is 0.9999 or more; cond of it."""
    cells = [F.corr(a, b).alias(f"{a}|{b}") for a in names for b in names]

    def run(frames):
        for frame in frames:
            for r in frame.to_dict("records"):
                m = np.array([[1.0 if a == b else r[f"{a}|{b}"] for b in names] for a in names])
                eig = np.linalg.eigvalsh(m)
                d = np.diag(np.linalg.pinv(m))
                yield pd.DataFrame({"factor": list(names), "vif": np.where(d >= 1e4, np.inf, d), "cond": eig[-1] / max(eig[0], 1e-300)})

    return factors_table.agg(*cells).mapInPandas(run, "factor string, vif double, cond double")


def high_pairs(factors_table: DataFrame, names: tuple[str, ...] = FACTORS, limit: float = 0.4) -> DataFrame:
    """a, b, corr of factor pairs with an absolute correlation over ``limit``."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    row = factors_table.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("p"))
    return row.select(F.inline("p")).filter(F.abs("corr") > limit)


def collinearity(factors_table: DataFrame, names: tuple[str, ...] = FACTORS, window: int = YEAR) -> DataFrame:
    """One row: largest vif, cond, number of high pairs, has_warning; over the last complete rows."""
    recent = factors_table.dropna().orderBy(F.desc("dt")).limit(window)
    v = vif(recent, names).agg(F.max("vif").alias("max_vif"), F.max("cond").alias("cond"))
    h = high_pairs(recent, names).agg(F.count("*").alias("high_pairs"))
    n = recent.agg(F.count("*").alias("n"))
    one = F.lit(1)
    out = v.withColumn("k", one).join(h.withColumn("k", one), "k").join(n.withColumn("k", one), "k").drop("k")
    return out.withColumn("has_warning", (F.col("n") >= 30) & ((F.col("max_vif") > 5) | (F.col("cond") > 10) | (F.col("high_pairs") > 0)))


def window_alphas(aligned: DataFrame, factors: tuple[str, ...], train: int = 126, step: int = 21) -> DataFrame:
    """(ticker, w, alpha) of regressions over rolling windows of ``train`` rows."""
    from tideline.operators.series import window_ids

    return regress(window_ids(aligned, train, step, train), factors, ("ticker", "w"), least=train)


def multi_window(aligned: DataFrame, factors: tuple[str, ...] = FACTORS, windows: tuple[int, ...] = (63, 126, 252)) -> DataFrame:
    """Regressions of the last 63, 126 and 252 rows, each only with as many rows; ticker, win and the regression."""
    w = W.partitionBy("ticker")
    rows = aligned.withColumn("_r", F.row_number().over(w.orderBy(F.desc("dt")))).withColumn("_c", F.count("*").over(w))
    use = F.filter(F.array(*[F.lit(x) for x in windows]), lambda x: (F.col("_r") <= x) & (F.col("_c") >= x))
    return regress(rows.withColumn("win", F.explode(use)), factors, ("ticker", "win"))


def consistency(multi: DataFrame) -> DataFrame:
    """Significant windows (abs t > 1.5), the sign of their majority, how many have it."""
    s = F.when(F.abs("t_alpha") > 1.5, F.signum("t_alpha"))
    per = multi.groupBy("ticker").agg(F.count("*").alias("n_windows"), F.signum(F.sum(s)).alias("majority"), F.collect_list(s).alias("signs"))
    return per.select("ticker", "n_windows", F.coalesce("majority", F.lit(0.0)).alias("majority"), F.size(F.filter("signs", lambda x: x == F.col("majority"))).alias("consistency"))


def residual_moments(rows: DataFrame, fits: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """ticker, g3 and g4 of standardised residuals (0 and 3 with three rows or fewer)."""
    fitted = F.col("alpha")
    for f in factors:
        fitted = fitted + F.col(f"beta_{f}") * F.col(f)
    z = (F.col("y") - fitted) / F.col("sigma")
    joined = rows.join(fits.select("ticker", "alpha", "sigma", *[f"beta_{f}" for f in factors]), "ticker").withColumn("z", z)
    return joined.groupBy("ticker").agg(F.when(F.count("*") > 3, F.avg(F.pow("z", 3))).otherwise(0.0).alias("g3"), F.when(F.count("*") > 3, F.avg(F.pow("z", 4))).otherwise(3.0).alias("g4"))


def decide(psr: Column, consistent: Column, majority: Column, oos: Column, deflated: Column) -> Column:
    buy = (psr > 0.85) & (consistent >= 2) & (majority > 0) & (oos.isNull() | (oos > 0.52)) & (deflated > 0)
    sell = (psr < 0.15) & (consistent >= 2) & (majority < 0) & (oos.isNull() | (oos < 0.48)) & (deflated < 0)
    return F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD")


def hit_rates(aligned: DataFrame, factors: tuple[str, ...], train: int = 126, step: int = 21) -> DataFrame:
    """ticker, oos: how often the sign of a window's alpha is that of the next rows' mean excess; null under two trials."""
    from tideline.operators.series import window_ids

    alphas = window_alphas(aligned, factors, train, step).select("ticker", "w", "alpha")
    ahead = window_ids(aligned, train, step, train + step).filter(F.col("pos") >= train).groupBy("ticker", "w").agg(F.avg("y").alias("ahead"))
    hits = alphas.join(ahead, ["ticker", "w"])
    return hits.groupBy("ticker").agg(F.when(F.count("*") >= 2, F.avg(((F.col("alpha") > 0) == (F.col("ahead") > 0)).cast("int"))).alias("oos"))


def robust_signal(aligned: DataFrame, factors: tuple[str, ...] = FACTORS, trials: int = 20) -> DataFrame:
    """psr, deflated ir, consistency, oos hit rate and the decision per ticker."""
    recent = tail(aligned, YEAR)
    fits = regress(recent, factors)
    moments = residual_moments(recent, fits, factors)
    multi = consistency(multi_window(aligned, factors))
    out = fits.filter("sigma > 0").join(moments, "ticker").join(multi, "ticker", "left").join(hit_rates(aligned, factors), "ticker", "left")
    ir = F.col("alpha") / F.col("sigma")
    out = out.withColumn("ir_d", ir).withColumn("psr", S.norm_cdf(S.psr_z("ir_d", "n", "g3", "g4"))).withColumn("deflated", (F.col("ir_d") - S.expected_max_ir(F.lit(trials), "n")) * math.sqrt(YEAR))
    zero = F.lit(0)
    decision = decide(F.col("psr"), F.coalesce("consistency", zero), F.coalesce("majority", zero), F.col("oos"), F.col("deflated"))
    return out.select("ticker", "n", "ir_d", "psr", "deflated", F.coalesce("n_windows", zero).alias("n_windows"), F.coalesce("consistency", zero).alias("consistency"), F.coalesce("majority", F.lit(0.0)).alias("majority"), "oos", decision.alias("robust"))


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) with ordinal ranks, ties by ticker."""
    w = W.partitionBy(by)
    ranked = rows.withColumn("_rx", F.row_number().over(w.orderBy(x, "ticker"))).withColumn("_ry", F.row_number().over(w.orderBy(y, "ticker")))
    n = F.count("*").cast("double")
    return ranked.groupBy(by).agg(F.count("*").alias("n"), (1 - 6 * F.sum(F.pow(F.col("_rx") - F.col("_ry"), 2)) / (n * (n * n - 1))).alias("ic"))


def ic_summary(ics: DataFrame, forward: int = 21) -> DataFrame:
    """mean, sd, t, icir of information coefficients over periods, and p = erfc(abs t / sqrt 2)."""
    m, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    out = ics.agg(n.alias("periods"), m.alias("mean_ic"), sd.alias("sd_ic"), F.when(n >= 2, m / (sd / F.sqrt(n))).alias("t"), F.when(n >= 2, m / sd * math.sqrt(YEAR / forward)).alias("icir"))
    return out.withColumn("p", S.erfc(F.abs("t") / math.sqrt(2)))


def added_r2(five: DataFrame, six: DataFrame, extra: str) -> DataFrame:
    """One row: mean and median R2 gain, mean abs t of the extra factor, share over 2."""
    both = five.select("ticker", F.col("r2").alias("r5")).join(six.select("ticker", F.col("r2").alias("r6"), F.abs(f"t_{extra}").alias("t")), "ticker").filter("r5 is not null and r6 is not null")
    return both.agg(F.count("*").alias("n"), F.avg(F.col("r6") - F.col("r5")).alias("mean_dr2"), F.median(F.col("r6") - F.col("r5")).alias("median_dr2"), F.avg("t").alias("mean_t"), F.avg((F.col("t") > 2).cast("int")).alias("share_t2"))


def implied_mean(aligned: DataFrame, rf: float = 0.035, least: int = 60) -> DataFrame:
    """ticker, mu: rf + 252 mean excess (what the regression's alpha and premia sum to), 252 mean return under ``least`` rows."""
    return aligned.groupBy("ticker").agg(F.when(F.count("*") >= least, rf + YEAR * F.avg("y")).otherwise(YEAR * F.avg("ret")).alias("mu"))
