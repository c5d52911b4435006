"""Queries over whole relations, against brute force on rows that earlier cuts left out."""

import datetime
import random

import pytest

START = datetime.date(2000, 1, 1)


def day(k):
    return START + datetime.timedelta(days=k)


@pytest.fixture(scope="module")
def series():
    rng = random.Random(11)
    out = {}
    for name, n, drift in (("A", 3600, 0.02), ("B", 500, -0.03), ("C", 29, 0.0)):
        close, rows = 200.0, []
        for k in range(n):
            close = max(5.0, close + drift + rng.uniform(-1, 1))
            rows.append((name, day(k), close, float(rng.randrange(100, 1000))))
        out[name] = rows
    return out


@pytest.fixture
def long_prices(spark, series, monkeypatch):
    from tideline.plans import fixtures as fx

    df = spark.createDataFrame([r for rows in series.values() for r in rows], "ticker string, dt date, close double, volume double").repartition(4)
    monkeypatch.setattr(fx, "prices", lambda s, d: df)


def smooth(xs, alpha, least):
    out, s = [], None
    for k, x in enumerate(xs):
        s = x if s is None else s + alpha * (x - s)
        out.append(s if k >= least - 1 else None)
    return out


def macd_of(close):
    fast, slow = smooth(close, 2 / 13, 12), smooth(close, 2 / 27, 26)
    macd = [None if b is None else a - b for a, b in zip(fast, slow)]
    signal = [None] * 25 + smooth([m for m in macd if m is not None], 0.2, 9)
    return macd, signal[: len(close)]


def rsi_of(close):
    step = [0.0, *[b - a for a, b in zip(close, close[1:])]]
    gain, loss = (smooth([max(f * x, 0.0) for x in step], 1 / 14, 14) for f in (1, -1))
    return [None if g is None else 100.0 if v == 0 else 100 - 100 / (1 + g / v) for g, v in zip(gain, loss)]


def close_to(a, b):
    return a is b is None or (a is not None and b is not None and abs(a - b) < 2e-5)


def test_smoothed_queries_on_long_series(spark, series, long_prices):
    from tideline import plans

    with pytest.raises(OverflowError):  # what one unblocked power would do
        pow(0.8, 1 - len(series["A"]))
    ema = {(r.ticker, r.dt): r for r in plans.QUERIES["win_ema"](spark, "").collect()}
    rsi = {(r.ticker, r.dt): r.rsi14 for r in plans.QUERIES["win_rsi"](spark, "").collect()}
    assert len(ema) == len(rsi) == sum(map(len, series.values()))
    for rows in series.values():
        close = [r[2] for r in rows]
        macd, signal = macd_of(close)
        for r, e, m, s, i in zip(rows, smooth(close, 2 / 21, 20), macd, signal, rsi_of(close)):
            got = ema[r[:2]]
            assert close_to(got.ema20, e) and close_to(got.macd, m) and close_to(got.macd_signal, s) and close_to(rsi[r[:2]], i)


def test_indicators_and_signals_are_of_the_last_day(spark, series, long_prices):
    from tideline import plans

    last = {r.ticker: r for r in plans.QUERIES["k_indicators"](spark, "").collect()}
    score = {r.ticker: r.score for r in plans.QUERIES["k_signals"](spark, "").collect()}
    assert set(last) == set(score) == {"A", "B"}
    for name in score:
        rows = series[name]
        close, volume = [r[2] for r in rows], rows[-1][3]
        mean = lambda n: sum(close[-n:]) / n
        sd = (sum((x - mean(20)) ** 2 for x in close[-20:]) / 20) ** 0.5
        got, c = last[name], close[-1]
        assert got.dt == rows[-1][1] and close_to(got.close, c) and close_to(got.sma20, mean(20)) and close_to(got.bb_upper, mean(20) + 2 * sd)
        macd, signal = macd_of(close)
        rsi, vol10 = rsi_of(close)[-1], sum(r[3] for r in rows[-10:]) / 10
        rules = [1.0 if mean(50) > mean(200) else -1.0, 0.5 if c > mean(20) else -0.5, 1.0 if macd[-1] > signal[-1] else -1.0, 1.5 if rsi < 30 else -1.5 if rsi > 70 else 0.0]
        rules += [1.0] if c <= mean(20) - 2 * sd else [-1.0] if c >= mean(20) + 2 * sd else []
        rules += [0.5] if volume / vol10 > 1.5 else []
        assert close_to(score[name], sum(rules) / len(rules))


def test_ic_windows_reach_the_end(spark, monkeypatch):
    from tideline import plans
    from tideline.plans import fixtures as fx

    rng = random.Random(5)
    rets = {t: [round(rng.gauss(0, 0.01), 9) for _ in range(147 + 21 * 25)] for t in "ABCDE"}
    df = spark.createDataFrame([(t, day(k), x) for t, xs in rets.items() for k, x in enumerate(xs)], "ticker string, dt date, ret double")
    monkeypatch.setattr(fx, "returns", lambda s, d: df)
    ranks, hits = {}, {t: [] for t in rets}
    for w in range(26):
        x, z = ({t: round(sum(xs[21 * w + a : 21 * w + b]), 9) for t, xs in rets.items()} for a, b in ((0, 126), (126, 147)))
        for t in rets:
            hits[t].append((x[t] > 0) == (z[t] > 0))
            ranks[w, t] = tuple(sorted(v, key=lambda k: (v[k], k)).index(t) + 1 for v in (x, z))
    ics = {w: 1 - 6 * sum((a - b) ** 2 for (k, _), (a, b) in ranks.items() if k == w) / (5 * 24) for w in range(26)}
    assert {(r.w, r.ticker): (r.rx, r.ry) for r in plans.QUERIES["win_rank_ic"](spark, "").collect()} == ranks
    got = {r.w: r.ic for r in plans.QUERIES["agg_spearman_ic"](spark, "").collect()}
    assert set(got) == set(ics) and all(close_to(got[w], ics[w]) for w in ics)
    summary = plans.QUERIES["agg_ic_summary"](spark, "").first()
    assert summary.periods == 26 and close_to(summary.mean_ic, sum(ics.values()) / 26)
    assert all(close_to(r.hit_rate, sum(hits[r.ticker]) / 26) for r in plans.QUERIES["agg_hit_rate"](spark, "").collect())


def test_all_paths_and_all_parts(spark, monkeypatch):
    import math

    from tideline import plans
    from tideline.plans import fixtures as fx

    rng = random.Random(6)
    orders = [(c * 10 + k, c, day(rng.randrange(900)), rng.uniform(1000, 400000)) for c in range(150, 300) for k in range(9)]
    part = [(k, f"Brand#1{1 + k % 4}", k) for k in range(40)]
    lines = [(rng.randrange(40), day(rng.randrange(20)), float(rng.randrange(1, 50)), rng.uniform(900, 9000)) for _ in range(600)]
    tables = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double"),
        "part": spark.createDataFrame(part, "p_partkey long, p_brand string, p_size int"),
        "lineitem": spark.createDataFrame(lines, "l_partkey long, l_shipdate date, l_quantity double, l_extendedprice double"),
    }
    monkeypatch.setattr(fx, "table", lambda s, d, name: tables[name])
    falls, called, totals = {}, {}, []
    for c in range(150, 300):
        nav = peak = 1.0
        falls[c], called[c] = 0.0, False
        for _, _, _, price in sorted((o for o in orders if o[1] == c), key=lambda o: (o[2], o[0])):
            nav *= 1 + (price - 200000) / 4000000
            peak = max(peak, nav)
            falls[c], called[c] = min(falls[c], nav / peak - 1), called[c] or (nav - 0.7) / nav < 0.25
        totals.append(nav - 1)
    got = {r.path: r.drawdown for r in plans.QUERIES["win_drawdown_nav"](spark, "").collect()}
    assert set(got) == set(falls) and all(close_to(got[c], falls[c]) for c in falls)
    assert {r.path: r.called for r in plans.QUERIES["fn_margin"](spark, "").collect()} == called
    tail = plans.QUERIES["agg_mc_tail"](spark, "").first()
    at = sorted(totals)[7] + 0.45 * (sorted(totals)[8] - sorted(totals)[7])  # 0.05 x 149 = 7.45
    assert close_to(tail.var_95, -at) and close_to(tail.p_loss_5, sum(t < -0.05 for t in totals) / 150)
    assert abs(plans.QUERIES["agg_mc_decision"](spark, "").first().win_rate - sum(t > 0 for t in totals) / 150) <= 5.1e-5  # 4 digits
    sums = {}
    for k, dt, quantity, price in lines:
        a = sums.setdefault((part[k][1], dt), [0.0, 0.0])
        a[0], a[1] = a[0] + price, a[1] + quantity
    closes = {(r.ticker, r.dt): r.close for r in plans.QUERIES["src_batch_close"](spark, "").collect()}
    assert set(closes) == set(sums) and all(close_to(closes[k], 100 + 10 * math.log(a / b)) for k, (a, b) in sums.items())


def test_correlations_use_every_residual_and_start_at_the_last_state(spark):
    import numpy as np

    from tideline.kernels.paths import simulate
    from tideline.operators.path_models import path_model

    rng = np.random.default_rng(8)
    n = 900
    x, y = rng.standard_normal((2, n))
    y = np.where(np.arange(n) < 150, 0.95 * x + 0.3 * y, y)  # linked in the oldest rows only
    rows = [(t, day(k), float(v) * 0.01) for t, s in (("A", x), ("B", y)) for k, v in enumerate(s)]
    _, model = path_model(spark.createDataFrame(rows, "ticker string, dt date, ret double"))
    model.residuals = np.array([r.z for r in model.residuals.orderBy("dt").collect()])
    base = np.corrcoef(model.residuals.T)
    assert len(model.residuals) == n and np.allclose(model.corr, base) and abs(base[0, 1] - np.corrcoef(model.residuals[-750:].T)[0, 1]) > 0.05
    q, (a, b) = base, model.dcc
    for e in model.residuals:
        q = (1 - a - b) * base + a * np.outer(e, e) + b * q
    assert np.allclose(model.start, q) and not np.allclose(q, base)
    model.start, model.residuals, model.jumps = np.array([[1.0, 0.8], [0.8, 1.0]]), None, {}
    first = simulate(model, 40_000, 1, "hawkes", np.random.default_rng(1))[:, 0]
    assert abs(np.corrcoef(first.T)[0, 1] - 0.8) < 0.02


@pytest.mark.parametrize("name", ["k_paths_hawkes", "k_paths_garch", "k_paths_gbm", "k_simulate", "k_mc_portfolio", "rep_montecarlo"])
def test_path_queries_are_of_the_shipped_size(spark, monkeypatch, name):
    from tideline import plans
    from tideline.operators import montecarlo as C

    sizes = []

    def simulated(spark, model, weights, paths, steps, kind):
        sizes.append((paths, steps))
        return spark.createDataFrame([(0, 1, 0.01), (0, 2, -0.01), (1, 1, 0.02), (1, 2, -0.03)], "path long, step long, ret double")

    def ends(*args):
        return C.path_ends(C.nav_paths(simulated(*args)))

    monkeypatch.setattr(C, "simulate_portfolio", simulated)
    monkeypatch.setattr(C, "simulated_ends", ends)
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() and sizes == [(50_000, 21)]


def test_lookups_of_any_size(spark):
    """The 1,001st currency has its rate, the 101st window its rows: no lookup table is cut."""
    from tideline.operators import portfolio, stress

    fx = spark.createDataFrame([(f"C{k}", 2.0 + k) for k in range(1500)], "currency string, rate_eur double")
    held = spark.createDataFrame([(f"C{k}", 1.0, 1.0) for k in range(1500)], "currency string, mv_native double, cost_native double")
    assert all(r.market_value_eur == 2.0 + int(r.currency[1:]) for r in portfolio.to_eur(held, fx).collect())
    windows = stress.windows_table(spark, [(f"S{k}", "2020-01-01", "2020-01-31") for k in range(1200)])
    prices = spark.sql("select 'A' ticker, date '2020-01-15' dt, 1.0D close")
    assert stress.in_windows(prices, windows).count() == 1200


def test_html_shows_every_row(spark):
    from tideline.operators import report

    page = report.html("t", {"s": spark.range(450).selectExpr("id", "cast(null as double) v")})
    assert page.count("<tr>") == 451 and page.count("N/A") == 450


def test_path_ends_in_blocks(spark):
    """What blocks say of their paths is what windows over all steps say."""
    import numpy as np

    from tideline.kernels.paths import Model
    from tideline.operators import montecarlo as C

    one = np.ones(2)
    model = Model(0 * one, 1e-5 * one, 0.05 * one, 0.9 * one, 2e-4 * one, np.eye(2), (0.02, 0.95), np.zeros((30, 2)), {"base": 0.01 * one, "excite": 0.1 * one, "mean": 0 * one, "sd": 0.02 * one, "decay": 0.5}, np.eye(2))
    args = spark, model, np.array([0.6, 0.4]), 2500, 9, "gbm"
    a = {r.path: r for r in C.simulated_ends(*args).collect()}
    b = {r.path: r for r in C.path_ends(C.nav_paths(C.simulate_portfolio(*args))).collect()}
    assert set(a) == set(b) and len(a) == 2500
    assert all(abs(a[p][c] - b[p][c]) < 1e-9 for p in a for c in ("total", "drawdown", "m", "s", "down"))
