"""Kernels and identities against plain NumPy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def days(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(n)]


def frame(spark, values, name="ret", ticker="A"):
    return spark.createDataFrame([(ticker, d, float(v)) for d, v in zip(days(len(values)), values)], f"ticker string, dt date, {name} double")


@pytest.fixture(scope="module")
def aligned(spark):
    """The synthetic five-factor recipe: 300 rows, beta 1.1."""
    rng = np.random.default_rng(42)
    x = rng.normal(0, 0.01, (300, 6))
    y = 1.1 * x[:, 0] + 0.0003 + rng.normal(0, 0.008, 300)
    rows = [("S", d, float(r), *map(float, f[:5]), 0.00012, float(r) - 0.00012) for d, r, f in zip(days(300), y, x)]
    rows += [("short", *r[1:]) for r in rows[:30]] + [("flat", r[1], 0.0, *[0.01] * 5, 0.0, 0.0) for r in rows]
    return spark.createDataFrame(rows, "ticker string, dt date, ret double, mkt_rf double, smb double, hml double, rmw double, cma double, rf double, y double")


def test_regression(aligned):
    from tideline.operators.factors import FACTORS, factor_regression

    out = {r.ticker: r for r in factor_regression(aligned).collect()}
    r = out["S"]
    assert r.alpha_ann == pytest.approx(-0.220719, abs=1e-5) and r.t_alpha == pytest.approx(-1.758015, abs=1e-5) and r.signal == "SELL"
    assert r.ir == pytest.approx(-1.793079, abs=1e-5) and r.r2 == pytest.approx(0.701158, abs=1e-5)
    assert [r[f"beta_{f}"] for f in FACTORS] == pytest.approx([1.101060, -0.038057, -0.086568, 0.021821, 0.061499], abs=1e-5)
    assert out["short"].alpha is None and out["flat"].t_alpha is None and out["flat"].signal == "HOLD"


def test_vif_is_that_of_auxiliary_regressions(aligned):
    from tideline.operators.factors import FACTORS, vif

    x = aligned.filter("ticker = 'S'").select(*FACTORS).toPandas().to_numpy()
    got = {r.factor: r.vif for r in vif(aligned.filter("ticker = 'S'")).collect()}
    for k, f in enumerate(FACTORS):
        others = np.column_stack([np.ones(len(x)), np.delete(x, k, 1)])
        e = x[:, k] - others @ np.linalg.lstsq(others, x[:, k], rcond=None)[0]
        assert got[f] == pytest.approx(((x[:, k] - x[:, k].mean()) ** 2).sum() / (e**2).sum(), rel=1e-9)


def test_attribution_adds_up(aligned):
    from tideline.operators.factors import attribution

    betas = aligned.filter("ticker = 'S'").groupBy("ticker").agg(F.regr_slope("y", "mkt_rf").alias("mkt_rf"), F.regr_slope("y", "smb").alias("smb"))
    rows = attribution(aligned, betas, ("mkt_rf", "smb")).collect()
    assert rows[0].total == pytest.approx(21 * 0.00012 + sum(r.contrib for r in rows) + rows[0].alpha)


def test_ewma_recursion(spark):
    from tideline.operators.series import ema, ewma_variance

    r = np.random.default_rng(1).normal(0, 0.02, 700)
    v = [r[:21].var()]
    for x in r[:-1]:
        v.append(0.94 * v[-1] + 0.06 * x * x)
    got = [x["var"] for x in ewma_variance(frame(spark, r)).orderBy("dt").collect()]
    assert got == pytest.approx(v, rel=1e-9)
    assert {round(x["var"], 12) for x in ewma_variance(frame(spark, r[:20])).collect()} == {round(r[:20].var(), 12)}
    e = pd.Series(r).ewm(span=20, adjust=False).mean()
    got = [x.e for x in ema(frame(spark, r), "ret", 20, "e").orderBy("dt").collect()]
    assert got[:19] == [None] * 19 and got[19:] == pytest.approx(e[19:].tolist(), rel=1e-9)


def test_drawdown_and_moments(spark):
    from tideline.operators import moments as M
    from tideline.operators.series import drawdown, trailing_moments

    r = np.random.default_rng(2).standard_t(4, 400) * 0.01
    df = frame(spark, r)
    cum = np.cumprod(1 + r)
    assert [x.drawdown for x in drawdown(df).orderBy("dt").collect()] == pytest.approx((cum / np.maximum.accumulate(cum) - 1).tolist(), abs=1e-12)
    row = df.agg(M.skew("ret").alias("s"), M.kurtosis("ret").alias("k")).first()
    assert (row.s, row.k) == pytest.approx((pd.Series(r).skew(), pd.Series(r).kurt()))
    last = trailing_moments(df, 100).orderBy(F.desc("dt")).first()
    assert (last.skew, last.kurt) == pytest.approx((pd.Series(r[-101:-1]).skew(), pd.Series(r[-101:-1]).kurt()), rel=1e-6)
    var = M.historical_var(df).first()
    assert var.var_95 == pytest.approx(-np.percentile(r, 5))


def test_component_var_sums_to_var(spark):
    from tideline.operators import moments as M

    rng = np.random.default_rng(3)
    panel = rng.normal(0, 0.01, (200, 3)) @ rng.normal(size=(3, 3))
    rows = [(t, d, float(x)) for k, t in enumerate("ABC") for d, x in zip(days(200), panel[:, k])]
    cov = M.covariances(spark.createDataFrame(rows, "ticker string, dt date, ret double"))
    w = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.2)], "ticker string, weight double")
    out = M.component_var(w, cov)
    sigma = math.sqrt(np.array([0.5, 0.3, 0.2]) @ (np.cov(panel.T) * 252) @ np.array([0.5, 0.3, 0.2]))
    assert M.quadratic_form(w, cov).first().sigma == pytest.approx(sigma)
    assert out.agg(F.sum("component")).first()[0] == pytest.approx(M.Z95 * sigma) and out.agg(F.sum("pct")).first()[0] == pytest.approx(1)


def test_scalars(spark):
    from statistics import NormalDist

    from tideline.functions import scalars as S

    xs = [-3.0, -1.0, -0.2, 0.0, 0.5, 2.0]
    row = spark.range(1).select(*[S.norm_cdf(x).alias(f"c{k}") for k, x in enumerate(xs)], *[S.norm_ppf(p).alias(f"p{k}") for k, p in enumerate((0.01, 0.5, 0.9))]).first()
    assert [row[f"c{k}"] for k in range(6)] == pytest.approx([NormalDist().cdf(x) for x in xs], abs=2e-7)
    assert [row[f"p{k}"] for k in range(3)] == pytest.approx([NormalDist().inv_cdf(p) for p in (0.01, 0.5, 0.9)], abs=5e-4)
    row = spark.range(1).select(S.bond_coupon(F.lit("T 3 3/4 06/30/27")).alias("a"), S.bond_coupon(F.lit("T 4.5 12/31/28")).alias("b"), S.bond_maturity(F.lit("T 4.5 12/31/28")).alias("m"), S.broker_ticker(F.lit("AAPL_US_EQ")).alias("t"), S.bond_coupon(F.lit("AAPL")).alias("n"), S.dot_dash(F.lit("BRK.B")).alias("d")).first()
    assert tuple(row) == (3.75, 4.5, "12/31/28", "AAPL", None, "BRK-B")


def test_fits():
    from tideline.kernels import fits

    rng = np.random.default_rng(7)
    k, s = fits.gpd(0.02 / 0.2 * ((1 - rng.random(4000)) ** -0.2 - 1))
    assert (k, s) == pytest.approx((0.2, 0.02), rel=0.25)
    v, r = 1e-4, []
    for _ in range(3000):
        x = math.sqrt(v) * rng.standard_normal()
        r.append(x)
        v = 5e-6 + 0.1 * x * x + 0.85 * v
    g = fits.garch(np.array(r))
    assert g["ok"] and g["alpha"] == pytest.approx(0.1, abs=0.05) and g["alpha"] + g["beta"] == pytest.approx(0.95, abs=0.05)
    assert not fits.garch(np.array(r[:20]))["ok"] and math.isnan(fits.evt_var(np.array(r[:50])))
    assert fits.evt_var(np.array(r)) == pytest.approx(-np.percentile(r, 1), rel=0.15)


def test_critical_lines():
    """Corners, targets and the largest Sharpe ratio meet the conditions of optimality and beat random portfolios."""
    from tideline.kernels import critical_line as L

    rng = np.random.default_rng(11)
    for n, low, high in ((1, 0.0, 1.0), (6, 0.005, 0.3), (12, 0.0, 1.0), (9, 0.01, 0.2), (40, 0.0, 0.5)):
        a = rng.normal(size=(n, n + 2))
        cov, mu = a @ a.T * 0.01 + np.eye(n) * 0.001, np.round(rng.uniform(0.0, 0.2, n), 2)  # with ties
        c = L.corners(mu, cov, low, high)
        assert np.allclose(c.weights.sum(1), 1) and c.trade[-1] == 0 and (np.diff(c.trade) <= 1e-9).all()
        tests = [(w, (t * mu - cov @ w) / max(t, 1)) for t, w in zip(c.trade, c.weights)]
        best = L.tangency(c, mu, cov, 0.035)
        if mu @ best > 0.035:
            tests.append((best, mu - 0.035 - (mu @ best - 0.035) / (best @ cov @ best) * (cov @ best)))
        for w, g in tests:
            m, free = L.multipliers(w, g, low, high), (w > low + 1e-9) & (w < high - 1e-9)
            assert np.abs(m[free]).max(initial=0) < 1e-6 and m[w <= low + 1e-9].max(initial=-1) < 1e-6 and m[w >= high - 1e-9].min(initial=1) > -1e-6
        ratio = lambda w: (w @ mu - 0.035) / np.sqrt(w @ cov @ w)
        draws = [w for w in rng.dirichlet(np.ones(n) * 2, 4000) if w.min() >= low and w.max() <= high]
        assert not draws or ratio(best) >= max(map(ratio, draws)) - 1e-9
        for t in np.linspace(mu @ c.weights[-1], mu @ c.weights[0], 9):
            w = L.at_return(c, mu, t)
            assert w @ mu == pytest.approx(t, abs=1e-9) and all(x @ cov @ x >= w @ cov @ w - 1e-12 for x in draws if x @ mu >= t)
    assert L.corners(mu[:3], cov[:3, :3], 0.005, 0.3) is None and L.at_return(c, mu, 1.0) is None


def test_walk_forward_against_direct_windows(spark):
    """Weights from differences of cumulative sums equal those of each window's own rows; what they earn, and the dates."""
    import pandas as pd

    from tideline.kernels import critical_line as L
    from tideline.kernels.paths import psd
    from tideline.operators.walk_forward import KINDS, walk_forward

    rng = np.random.default_rng(5)
    days = pd.bdate_range("2015-01-01", periods=430)
    wide = pd.DataFrame(rng.normal(0.0005, 0.01, (430, 7)) + rng.normal(0, 0.005, (430, 1)), days, list("ABCDEFG"))
    wide = wide.mask(rng.random(wide.shape) < 0.1)
    wide.loc[days[:200], "G"] = np.nan  # listed late
    rows = [(t, d.date(), float(v), float(v) - 0.0001) for t in wide for d, v in wide[t].dropna().items()]
    got = walk_forward(spark.createDataFrame(rows, "ticker string, dt date, ret double, y double"), train=126, step=21, least=63, fewest=4).toPandas()
    before, want = {k: None for k in KINDS}, []
    for w, pos in enumerate(range(126, 430 - 21 + 1, 21)):
        train, test = wide.iloc[pos - 126 : pos], wide.iloc[pos : pos + 21]
        good = [c for c in wide if train[c].count() >= 63 and not train[c].iloc[:5].isna().all()]
        cov = psd(train[good].cov(min_periods=20).fillna(0).to_numpy() * 252, 1e-8)
        n, low = len(good), max(0.001, 0.5 / len(good))
        for kind, mu in (("implied", 0.035 + 252 * (train[good].mean() - 0.0001)), ("history", 252 * train[good].mean()), ("equal", None)):
            x = np.full(n, 1 / n) if mu is None else L.tangency(L.corners(mu.to_numpy(), cov, low, min(1.0, max(min(0.4, 5 / n), 2 * low))), mu.to_numpy(), cov, 0.035)
            r = test[good].ffill().fillna(0.0).to_numpy() @ x
            cum = np.cumprod(1 + r)
            now = dict(zip(good, x))
            turn = 1.0 if before[kind] is None else sum(abs(now.get(t, 0) - before[kind].get(t, 0)) for t in wide) / 2
            before[kind] = now
            vol = r.std() * math.sqrt(252)
            want.append((w, kind, n, train.index[0].date(), train.index[-1].date(), test.index[0].date(), test.index[-1].date(), 252 * r.mean(), vol, (252 * r.mean() - 0.035) / vol, (cum / np.maximum.accumulate(cum) - 1).min(), turn))
    names = ["window", "kind", "assets", "train_start", "train_end", "test_start", "test_end", "ann_ret", "ann_vol", "sharpe", "max_dd", "turnover"]
    a, b = got[names].sort_values(names[:2]).reset_index(drop=True), pd.DataFrame(want, columns=names).sort_values(names[:2]).reset_index(drop=True)
    assert len(a) == len(b) and (a[names[1:7]] == b[names[1:7]]).all().all()
    assert np.allclose(a[names[7:]], b[names[7:]], atol=1e-6)


def test_allocation(spark):
    from tideline.operators import allocation as A

    scores = spark.createDataFrame([(f"T{k}", float(s)) for k, s in enumerate([10, 1, 1, 1, 1, 1, 1])], "ticker string, score double")
    w = {r.ticker: r.weight for r in A.capped_weights(scores).collect()}
    assert sum(w.values()) == pytest.approx(1) and max(w.values()) == pytest.approx(0.2, abs=1e-6)
    few = {r.ticker: r.weight for r in A.capped_weights(scores.limit(3)).collect()}
    assert sum(few.values()) == pytest.approx(1)
    orders = spark.createDataFrame([(1, "A", 0.6, 100.0), (2, "B", 0.6, 5000.0), (3, "C", 0.5, 30.0)], "place long, ticker string, weight double, price double")
    assert [tuple(r) for r in A.budget_fold(orders, 10_000).collect()] == [("A", 60, 6000.0), ("C", 133, 3990.0)]
    t = spark.createDataFrame([(0, "A", 1.0), (1, "A", 0.5), (1, "B", 0.5), (2, "B", 1.0)], "w long, ticker string, weight double")
    assert [r.turnover for r in A.turnover(t).orderBy("w").collect()] == [1.0, 0.5, 0.5]


def test_paths():
    from tideline.kernels.paths import Model, simulate

    n = 3
    corr = np.full((n, n), 0.5) + np.eye(n) * 0.5
    rng = np.random.default_rng(5)
    model = Model(np.zeros(n), np.full(n, 5e-6), np.full(n, 0.1), np.full(n, 0.85), np.full(n, 1e-4), corr, residuals=rng.standard_normal((200, n)), jumps={"base": np.full(n, 0.02), "excite": np.full(n, 0.1), "decay": 0.5, "mean": np.zeros(n), "sd": np.full(n, 0.01)})
    for kind in ("gbm", "garch", "hawkes"):
        r = simulate(model, 4000, 5, kind, np.random.default_rng(1))
        assert r.shape == (4000, 5, n) and np.isfinite(r).all()
        assert r[:, 0].std() == pytest.approx(0.01, rel=0.25) and np.corrcoef(r[:, 0].T)[0, 1] == pytest.approx(0.5, abs=0.12)


def test_streams(spark, tmp_path):
    from tideline.streaming import bars as B

    rows = [("A", dt.datetime(2024, 1, 1, 10, m), float(m)) for m in range(0, 60, 7)] + [("B", dt.datetime(2024, 1, 1, 11, 5), 9.0), ("B", dt.datetime(2024, 1, 1, 10, 5), None)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, price double")
    for k in range(2):
        df.filter(F.col("ticker") == "AB"[k]).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = B.start_latest(stream, f"{tmp_path}/out", f"{tmp_path}/log")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/v{q.lastProgress['batchId']}").collect()
    assert {(r.ticker, r.price) for r in got} == {("A", 56.0), ("B", 9.0)}
    alerts = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 10)), ("k", dt.datetime(2024, 1, 1, 20)), ("j", dt.datetime(2024, 1, 1, 21))], "key string, ts timestamp")
    alerts.write.parquet(f"{tmp_path}/alerts")
    s = B.suppress_repeats(spark.readStream.schema(alerts.schema).parquet(f"{tmp_path}/alerts"))
    q = s.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.sql("select * from kept").collect()) == ["j", "k"]


def test_upsert_and_snapshots(spark, tmp_path):
    from tideline.sources import market as M
    from tideline.sources.services import substitute, with_retries, write_report

    one = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    M.save_upsert(spark, f"{tmp_path}/t", one, ["k"])
    out = M.save_upsert(spark, f"{tmp_path}/t", spark.createDataFrame([("B", 3), ("C", 4)], "k string, v int"), ["k"])
    assert sorted(map(tuple, out.collect())) == [("A", 1), ("B", 3), ("C", 4)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"x": 1}')
    (tmp_path / "s" / "b.json").write_text("{broken")
    assert [r.x for r in M.read_snapshots(spark, f"{tmp_path}/s", "x int").collect()] == [1]
    assert substitute("a ${B} ${C}", {"B": "1"}) == "a 1 ${C}"
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert with_retries(flaky, sleep=lambda s: None) == "ok"
    assert write_report("<html>", str(tmp_path), "r").endswith("r.html")


def test_plans_stay_in_the_jvm_and_prune(spark):
    from tideline.plans import fixtures as fx

    plan = fx.holdings_eur(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "l_tax" in plan and "l_shipdate" not in plan.split("ReadSchema")[-1]


def test_least_squares_in_sql():
    """Sweeps and the condition number against NumPy, also on correlated columns and on one that is a sum of others."""
    import duckdb
    import numpy as np
    import pandas as pd

    from tideline.plans import least_squares as L

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) @ (np.eye(5) + 0.4 * rng.normal(size=(5, 5)))
    rows = pd.DataFrame(x, columns=list(L.FACTORS)).assign(y=x @ [0.5, -0.2, 0.1, 0.0, 1.0] + rng.normal(size=300), ticker="A")
    flat = rows.assign(ticker="B", cma=rows.mkt_rf + rows.smb)
    few = rows.head(20).assign(ticker="C")
    con = duckdb.connect()
    con.register("t", pd.concat([rows, flat, few]))
    got = con.execute(L.regression("select * from t")).df().set_index("ticker")
    design = np.c_[np.ones(300), x]
    coef, rss = np.linalg.lstsq(design, rows.y, rcond=None)[:2]
    se = np.sqrt(rss[0] / (300 - 6) * np.diag(np.linalg.inv(design.T @ design)))
    a = got.loc["A"]
    assert np.allclose([a.alpha, *[a[f"beta_{f}"] for f in L.FACTORS]], coef)
    assert np.allclose([a.se_alpha, *[a[f"se_{f}"] for f in L.FACTORS]], se)
    assert np.isnan(got.loc["B"].alpha) and np.isnan(got.loc["C"].alpha) and got.loc["C"].n == 20
    only = "select * exclude (y) from t where ticker = 'A'"
    corr = np.corrcoef(x.T)
    assert np.isclose(con.execute(L.condition(only)).fetchone()[0], np.linalg.cond(corr))
    vif = dict(con.execute(L.vifs(only)).fetchall())
    assert np.allclose([vif[f] for f in L.FACTORS], np.diag(np.linalg.inv(corr)))


def test_optimum_and_frontier_against_their_sql():
    """Where no portfolio earns the riskless rate the optimum is an extreme one; the frontier starts at the target of least variance."""
    import duckdb

    from tideline.kernels import critical_line as L
    from tideline.operators import optimise as O
    from tideline.plans import quadratic as D

    rng, con = np.random.default_rng(3), duckdb.connect()
    con.execute("create table m(ticker varchar, mu double); create table c(a varchar, b varchar, cov double)")
    mu_sql, cov_sql, names = "select * from m", "select * from c", list("ABCDE")
    solved, problems = O._solved, O.problems
    try:
        for level in (0.0125, 0.02, 0.034, 0.09) * 5:
            mean, a = level + 0.001 * rng.standard_normal(5), rng.standard_normal((60, 5))
            cov = np.cov(a.T) * 0.005
            con.execute("delete from m; delete from c")
            con.executemany("insert into m values (?, ?)", [(t, float(x)) for t, x in zip(names, mean)])
            con.executemany("insert into c values (?, ?, ?)", [(s, t, float(cov[i, j])) for i, s in enumerate(names) for j, t in enumerate(names)])
            O.problems, O._solved = lambda *_: None, lambda _, solve, __: solve(names, mean, cov)
            best = con.execute(D.tangency(mu_sql, cov_sql, 0.005, 0.30)).fetchall()
            assert [r[0] for r in sorted(best)] == names and np.allclose([r[1:] for r in O.optimal(None, None)], [r[1:] for r in sorted(best)], atol=1e-8)
            curve = con.execute(f"select point, target, vol, ret from ({D.frontier(mu_sql, cov_sql)}) order by point").fetchall()
            assert [r[0] for r in O.trace(None, None)] == [r[0] for r in curve] and np.allclose(O.trace(None, None), curve, atol=1e-8)
    finally:
        O._solved, O.problems = solved, problems
    # more assets: no random portfolio is better than the extreme one, and equal means give the least variance at the edge
    a = rng.normal(size=(12, 14))
    cov, excess = a @ a.T * 0.01, -rng.uniform(0.01, 0.03, 12)
    w = L.best_extreme(excess, cov, 0.01, 0.2)
    assert w.sum() == pytest.approx(1) and w.min() >= 0.01 and w.max() <= 0.2 + 1e-12
    draws = 0.01 + (1 - 0.12) * rng.dirichlet(np.ones(12), 20_000)
    ratio = lambda x: (x @ excess) / np.sqrt(np.einsum("...i,ij,...j", x, cov, x))
    assert ratio(w) >= ratio(draws[draws.max(1) <= 0.2]).max()
    low = L.least_variances(np.array([0.1, 0.1, 0.2]), np.diag([0.04, 0.01, 0.04]), np.array([0.1]))[0]
    assert low == pytest.approx([0.2, 0.8, 0.0], abs=1e-6)
