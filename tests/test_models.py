"""Fits by aggregations and scans against loops over rows."""

import datetime
import math

import numpy as np
import pytest


def frame(spark, series):
    day = lambda k: datetime.date(2010, 1, 1) + datetime.timedelta(k)
    return spark.createDataFrame([(t, day(k), float(v)) for t, s in series.items() for k, v in enumerate(s)], "ticker string, dt date, ret double")


def garch_path(rng, n, omega=5e-6, alpha=0.1, beta=0.85):
    v, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        out.append(math.sqrt(v) * rng.standard_normal())
        v = omega + alpha * out[-1] ** 2 + beta * v
    return np.array(out)


def test_scan_is_the_loop(spark):
    from tideline.operators.variance import scanned

    rng = np.random.default_rng(1)
    x = rng.exponential(1, 1500)
    rows = spark.createDataFrame([(j, t, float(v), b) for j, b in enumerate((0.0001, 0.3, 0.9, 0.999)) for t, v in enumerate(x)], "j int, t int, x double, beta double")
    got = {(r.j, r.t): r.s for r in scanned(rows, ["j"]).collect()}
    for j, b in enumerate((0.0001, 0.3, 0.9, 0.999)):
        s = 0.0
        for t, v in enumerate(x):
            assert got[j, t] == pytest.approx(s, rel=1e-9, abs=1e-12)
            s = v + b * s


def test_garch_of_many_series(spark):
    from tideline.kernels import fits
    from tideline.operators import variance as H

    rng = np.random.default_rng(3)
    series = {"A": garch_path(rng, 2500), "B": garch_path(rng, 1500, 2e-5, 0.2, 0.6) + 0.001, "C": rng.normal(0, 0.01, 40), "flat": np.zeros(80)}
    r = frame(spark, series)
    for mean in (True, False):
        got = {x.ticker: x for x in H.fit_garch(r, mean).collect()}
        assert not got["C"].ok and not got["flat"].ok and got["C"].alpha == 0.10
        for t in "AB":
            x, e2 = got[t], (series[t] - (series[t].mean() if mean else 0)) ** 2
            loop = lambda o, a, b: fits._recursion(e2, o, a, b, e2.mean())  # noqa: E731, B023
            v = loop(x.omega, x.alpha, x.beta)
            assert x.next_var == pytest.approx(v[-1], rel=1e-9)
            g = fits.garch(series[t], mean)
            w = loop(g["omega"], g["alpha"], g["beta"])
            loss = lambda v: float(np.sum(np.log(v[:-1]) + e2 / v[:-1]))  # noqa: E731, B023
            assert x.ok and loss(v) <= loss(w) + 0.1
            if mean:
                z = [q.z for q in H.residuals(r.filter(f"ticker = '{t}'"), H.fit_garch(r, True)).orderBy("dt").collect()]
                assert np.allclose(z, (series[t] - series[t].mean()) / np.sqrt(v[:-1]), rtol=1e-8)
            else:
                assert x.mean == 0


def test_correlations_of_two_assets_are_the_full_fit(spark):
    from tideline.kernels import fits
    from tideline.operators.variance import fit_correlations

    rng = np.random.default_rng(4)
    n, q, out = 900, np.array([[1, 0.5], [0.5, 1.0]]), []
    base = q.copy()
    for _ in range(n):
        d = np.sqrt(np.diag(q))
        out.append(np.linalg.cholesky(q / np.outer(d, d)) @ rng.standard_normal(2))
        q = 0.05 * base + 0.05 * np.outer(out[-1], out[-1]) + 0.9 * q
    z = np.array(out)
    a, b, corr = fits.dcc(z)
    rows = frame(spark, {"A": z[:, 0], "B": z[:, 1], "S": z[:30, 0]}).withColumnRenamed("ret", "z")
    got = {(r.a, r.b): r for r in fit_correlations(rows).collect()}
    assert len(got) == 9 and got["A", "A"].corr == 1.0
    assert (got["A", "B"].dcc_a, got["B", "A"].dcc_b) == pytest.approx((a, b)) and got["A", "B"].corr == pytest.approx(corr[0, 1])
    few = fit_correlations(rows.filter("ticker = 'S' or dt < '2010-01-20'")).first()
    assert (few.dcc_a, few.dcc_b) == (0.03, 0.93)


def test_tails_of_many_series(spark):
    from tideline.kernels import fits
    from tideline.operators.tails import excesses, pareto_fits, tail_var

    rng = np.random.default_rng(6)
    series = {"heavy": rng.standard_t(3, 3000) * 0.01, "thin": rng.uniform(-1, 1, 2000), "normal": rng.normal(0, 0.01, 900), "few": rng.normal(0, 0.01, 90), "none": rng.normal(0, 1, 50)}
    r = frame(spark, series)
    got = {x.ticker: x.var_evt for x in tail_var(r).collect()}
    assert set(got) == set(series) - {"none"}
    assert got["few"] == pytest.approx(np.percentile(-series["few"], 99))
    fit = {x.ticker: x for x in pareto_fits(excesses(r)).collect()}
    for t in ("heavy", "thin", "normal"):
        loss = -series[t]
        x = loss[loss > (u := np.percentile(loss, 90))] - u
        like = lambda k, s: -len(x) * math.log(s) - (1 + 1 / k) * np.log1p(k * x / s).sum()  # noqa: E731, B023
        assert like(fit[t].shape, fit[t].scale) >= like(*fits.gpd(x)) - 1e-3
        assert got[t] == pytest.approx(fits.evt_var(series[t]), rel=0.01)


def test_cholesky_in_blocks(spark):
    """L L' is the matrix for sizes around a block's; a singular matrix takes jitter, an indefinite one is refused."""
    from tideline.operators.cholesky import cholesky

    rng = np.random.default_rng(9)

    def table(m):
        return spark.createDataFrame([(f"t{i:03}", f"t{j:03}", float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "a string, b string, value double")

    for n, size in ((1, 4), (4, 4), (7, 3)):
        a = rng.normal(size=(n, n + 2))
        m, low = a @ a.T, np.zeros((n, n))
        for r in cholesky(table(m), size).collect():
            low[int(r.a[1:]), int(r.b[1:])] = r.value
            assert r.jitter == 0
        assert np.allclose(low, np.linalg.cholesky(m))
    flat = np.ones((3, 3))
    got = cholesky(table(flat), 2).collect()
    low = np.zeros((3, 3))
    for r in got:
        low[int(r.a[1:]), int(r.b[1:])] = r.value
    assert got[0].jitter > 0 and np.allclose(low @ low.T, flat, atol=1e-3)
    with pytest.raises(ValueError, match="positive"):
        cholesky(table(np.array([[1.0, 2.0], [2.0, 1.0]])), 2)
    assert cholesky(table(np.zeros((0, 0)))).count() == 0


def test_paths_draw_residuals_from_a_table(spark):
    """A table of residuals gives the paths that the same array gives; without dates common to all, paths are normal."""
    from dataclasses import replace

    from tideline.kernels.paths import Model
    from tideline.operators import montecarlo as C

    one, z = np.ones(2), np.random.default_rng(4).standard_normal((80, 2))
    model = Model(0 * one, 1e-5 * one, 0.05 * one, 0.9 * one, 2e-4 * one, np.eye(2), (0.02, 0.95), z, {}, np.eye(2))
    table = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(k), list(map(float, r))) for k, r in enumerate(z)], "dt date, z array<double>")
    ends = lambda m: {r.path: r.total for r in C.simulated_ends(spark, m, np.array([0.6, 0.4]), 4500, 5, "hawkes").collect()}
    a, b, none, normal = ends(model), ends(replace(model, residuals=table)), ends(replace(model, residuals=table.limit(0))), ends(replace(model, residuals=None))
    assert len(a) == 4500 and a == b and none == normal != a


def test_sample_model_is_of_the_last_rows(spark):
    from tideline.operators.path_models import sample_model

    rng = np.random.default_rng(5)
    x = rng.multivariate_normal([0, 0], [[1e-4, 6e-5], [6e-5, 2e-4]], 200)
    names, model = sample_model(frame(spark, {"A": x[:, 0], "B": x[:, 1]}))
    sd = np.sqrt(model.variance)
    assert names == ["A", "B"] and np.allclose(model.corr * np.outer(sd, sd), np.cov(x[-63:].T), rtol=1e-6) and not model.mean.any()
