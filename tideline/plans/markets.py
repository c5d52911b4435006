"""Queries of kernels, stress, trading rules, service tables, report sections and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import allocation as A
from tideline.operators import factors as R
from tideline.operators import indicators as I
from tideline.operators import joins as J
from tideline.operators import moments as M
from tideline.operators import montecarlo as C
from tideline.operators import optimise as O
from tideline.operators import path_models as PM
from tideline.operators import portfolio as P
from tideline.operators import report as Q
from tideline.operators import series as X
from tideline.operators import stress as T
from tideline.operators import tails
from tideline.operators import variance as H
from tideline.operators import walk as V
from tideline.operators.cholesky import cholesky
from tideline.operators.walk_forward import walk_forward
from tideline.plans import fixtures as fx
from tideline.plans import quadratic as D
from tideline.plans import tail_sql
from tideline.plans.analytics import _CF, _ERFC, _G, _YEAR, _al, _attr, _attribution, _port, _ppf_of, _region_weights, _weights, _windows, paths
from tideline.plans.core import runs
from tideline.plans.registry import query
from tideline.plans.scratch import written
from tideline.streaming import bars as B
from tideline.streaming import live as L

_W = "(select ticker, sum(weight) weight from fx_eur group by 1)"

# ---------------------------------------------------------------- kernels


@query("k_gpd", tail_sql.tail_var("select ticker, ret from fx_returns"), d="var_evt")
def _(spark, d):
    return tails.tail_var(fx.returns(spark, d))


@query("k_garch_var")
def _(spark, d):
    return H.fit_garch(fx.returns_region(spark, d), mean=False).select("ticker", "next_var", "ok")


@query("k_port_sigma")
def _(spark, d):
    return O.portfolio_sigma(_al(spark, d), _region_weights(spark))


@query("k_fit_garch")
def _(spark, d):
    return H.fit_garch(_al(spark, d))


@query("k_fit_dcc")
def _(spark, d):
    r = written(_al(spark, d), "aligned")
    return H.fit_correlations(written(H.residuals(r, written(H.fit_garch(r), "garch")), "residuals"))


fx.SQL["fx_ewma_region"] = fx.SQL["fx_ewma"].replace("from fx_returns)", "from fx_returns_region)")
#: The factor by columns: each step takes the products of one column off the rest.
_CHOL = """with recursive m0 as (select list(a order by a) t, list(r order by a) m from (select a, list(corr order by b) r from fx_cov group by a)),
    f(t, m, l, k) as (select t, m, []::double[][], 1 from m0 union all
    select t, list_transform(range(1, len(t)+1), lambda i: list_transform(range(1, len(t)+1), lambda j: m[i][j] - m[i][k]*m[k][j]/m[k][k])), list_concat(l, [list_transform(range(1, len(t)+1), lambda i: m[i][k]/sqrt(m[k][k]))]), k+1 from f where k <= len(t))
    select t[i] a, t[j] b, l[j][i] as value, 0.0::double jitter from (select *, unnest(range(1, len(t)+1)) i from f where k = len(t)+1) , (select unnest(range(1, 6)) j) where j <= i"""


@query("k_chol", _CHOL, d="value jitter")
def _(spark, d):
    return cholesky(M.covariances(_al(spark, d)).select("a", "b", F.col("corr").alias("value")), size=2)


_JUMPS = "select *, lag(hit) over (partition by ticker order by dt) was from (select ticker, dt, (abs(ret) > 2*sqrt(var))::int hit, case when abs(ret) > 2*sqrt(var) then (abs(ret) - 2*sqrt(var))*sign(ret) end big from fx_ewma_region)"
_HAWKES = f"select ticker, base, 0.5*least(greatest(2*case when jumps > 2 and jumps < n and isfinite(rho) then rho else 0 end, 0), 0.8) excite, coalesce(mean, 0) mean, coalesce(sd, 0) sd from (select ticker, avg(hit) base, sum(hit) jumps, count(*) n, corr(hit, was) rho, avg(big) mean, stddev_samp(big) sd from ({_JUMPS}) group by 1)"


@query("k_hawkes_fit", _HAWKES, d="base excite mean sd")
def _(spark, d):
    return O.jump_fits(fx.returns_region(spark, d))


def _simulated(spark, d, kind, n=50_000, steps=21, simulate=None, model=None):
    names, model = (model or PM.path_model)(_al(spark, d))
    simulate = simulate or C.simulated_ends
    w = dict((r["ticker"], r["weight"]) for r in _region_weights(spark).collect())
    return simulate(spark, model, np.array([w[t] for t in names]), n, steps, kind)


@query("k_paths_hawkes")
def _(spark, d):
    return C.tail_metrics(written(_simulated(spark, d, "hawkes"), "paths"))


@query("k_paths_garch")
def _(spark, d):
    return C.tail_metrics(written(_simulated(spark, d, "garch"), "paths"))


@query("k_paths_gbm")
def _(spark, d):
    return C.tail_metrics(written(_simulated(spark, d, "gbm"), "paths"))


@query("k_simulate")
def _(spark, d):
    return _simulated(spark, d, "hawkes", simulate=C.simulate_portfolio).groupBy("step").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))


@query("k_mc_portfolio")
def _(spark, d):
    ends = written(_simulated(spark, d, "hawkes"), "paths")
    one = F.lit(1)
    cost = fx.holdings_eur(spark, d).agg(F.sum(S.trading_cost("market_value_eur", F.lit(500000.0))).alias("cost"))
    out = C.tail_metrics(ends).withColumn("k", one).join(C.decision_metrics(ends).withColumn("k", one), "k").join(cost.withColumn("k", one), "k")
    return out.drop("k")


@query("k_mc_simple")
def _(spark, d):
    ends = written(_simulated(spark, d, "gbm", 10_000, 30, model=PM.sample_model), "paths")
    return C.tail_metrics(ends).crossJoin(ends.agg(F.avg((F.col("total") > 0).cast("int")).alias("p_positive")))  # one row each


_TAIL = "select path, arg_max(nav, step)-1 total, min(d) drawdown from (select *, nav/greatest(1, max(nav) over (partition by path order by step))-1 d from fx_nav) group by 1"


@query("agg_mc_tail", f"with e as ({_TAIL}), q as (select quantile_cont(total, 0.05) q05, quantile_cont(total, 0.01) q01 from e) select any_value(-q05) var_95, any_value(-q01) var_99, -avg(case when total <= q05 then total end) cvar_95, -avg(case when total <= q01 then total end) cvar_99, -avg(case when total < 0 then total end) expected_loss, avg((total < -0.05)::int) p_loss_5, avg((total < -0.1)::int) p_loss_10, avg((total < -0.2)::int) p_loss_20, avg(drawdown) dd_mean, quantile_cont(drawdown, 0.05) dd_95 from e cross join q", d="var_95 var_99 cvar_95 cvar_99 expected_loss p_loss_5 p_loss_10 p_loss_20 dd_mean dd_95")
def _(spark, d):
    return C.tail_metrics(C.path_ends(C.nav_paths(paths(spark, d))))


@query("agg_mc_decision", f"with p as (select path, avg(ret) m, stddev_pop(ret) s, sqrt(avg(least(ret, 0)^2)) dn from fx_nav group by 1), e as ({_TAIL}), r as (select m*sqrt(252)/nullif(s,0) sharpe, m*sqrt(252)/nullif(dn,0) sortino, m*252/nullif(-drawdown,0) calmar, total from p join e using(path)) select quantile_cont(sharpe, 0.5) sharpe_median, quantile_cont(sharpe, 0.1) sharpe_p10, quantile_cont(sortino, 0.5) sortino_median, quantile_cont(calmar, 0.5) calmar_median, avg((total > 0)::int) win_rate from r", d="sharpe_median sharpe_p10 sortino_median calmar_median win_rate", digits=4)
def _(spark, d):
    return C.decision_metrics(C.path_ends(C.nav_paths(paths(spark, d))))


_BREAK = "with s as (select a t, sqrt(cov) s from fx_ewcov where a = b), q as (select sqrt(sum(x.weight*y.weight*cov)) sigma, sqrt(sum(x.weight*y.weight*sa.s*sb.s*case when a=b then 1 else 0.85 end)) sigma_break from fx_ewcov join fx_rw x on x.ticker=a join fx_rw y on y.ticker=b join s sa on sa.t=a join s sb on sb.t=b) select *, sigma_break/sigma ratio from q"


@query("k_corr_break", _BREAK, d="sigma sigma_break ratio")
def _(spark, d):
    return T.correlation_break(_region_weights(spark), M.ewma_covariances(_al(spark, d)))


@query("k_ff_mu", "select ticker, case when count(*) >= 60 then 0.035+252*avg(y) else 252*avg(ret) end mu from fx_aligned group by 1", d="mu")
def _(spark, d):
    return R.implied_mean(fx.aligned(spark, d))


def _region_aligned(spark, d):
    return J.align_factors(_al(spark, d), fx.factors(spark, d))


fx.SQL["fx_region_mu"] = "select ticker, case when count(*) >= 60 then 0.035+252*avg(ret-rf) else 252*avg(ret) end mu from fx_al join fx_factors using(dt) group by 1"
_MU, _COV = "select * from fx_region_mu", "select a, b, cov from fx_cov"
_BEST, _CURVE = D.tangency(_MU, _COV, 0.005, 0.30), D.frontier(_MU, _COV)


def _region_mu(spark, d):
    return R.implied_mean(_region_aligned(spark, d))


@query("k_max_sharpe", _BEST, d="weight multiplier")
def _(spark, d):
    return O.optimal(_al(spark, d), _region_mu(spark, d))


@query("k_frontier_qp", f"select point, target, vol, ret from ({_CURVE})", d="target vol ret", i="point")
def _(spark, d):
    return O.trace(_al(spark, d), _region_mu(spark, d))


@query("k_corners")
def _(spark, d):
    return O.corner_portfolios(_al(spark, d), _region_mu(spark, d))


@query("k_cloud")
def _(spark, d):
    return O.cloud(_al(spark, d), _region_mu(spark, d))


_POINT = "select any_value(sqrt(v)) vol, any_value(r) ret from (select sum(x.weight*y.weight*cov) v from fx_cov join ({0}) x on x.ticker=a join ({0}) y on y.ticker=b), (select sum(weight*mu) r from ({0}) join fx_region_mu using(ticker))"
fx.SQL["fx_best"] = _BEST


@query("k_frontier", f"select 'asset' kind, ticker as name, sqrt(cov) vol, mu ret, null::double weight from fx_region_mu join fx_cov on a = ticker and b = ticker union all select 'frontier', cast(point as varchar), vol, ret, null from ({_CURVE}) "
       f"union all select 'optimal', ticker, vol, ret, weight from fx_best, ({_POINT.format('select * from fx_best')}) union all select 'current', ticker, vol, ret, weight from fx_rw, ({_POINT.format('select * from fx_rw')})", d="vol ret weight")
def _(spark, d):
    return O.bundle(_al(spark, d), _region_mu(spark, d), _region_weights(spark))


#: What is held of each region's lines: its share of the value, and if it stands above its cost.
fx.SQL["fx_held"] = "select r_name ticker, sum(l_extendedprice)/sum(sum(l_extendedprice)) over () weight, sum(l_extendedprice) > sum(l_extendedprice*(1-l_discount)*(1+l_tax)) gain from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by 1"


def _held(spark, d):
    s, n, r = (fx.table(spark, d, x) for x in ("supplier", "nation", "region"))
    where = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", F.col("r_name").alias("ticker"))
    lines = fx.table(spark, d, "lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = lines.groupBy("ticker").agg(F.sum("l_extendedprice").alias("v"), F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("cost"))
    return sums.select("ticker", (F.col("v") / F.sum("v").over(P.every())).alias("weight"), (F.col("v") > F.col("cost")).alias("gain"))


_TIER = "case when abs(delta) < 0.02 then 3 when (gain and delta < 0) or abs(delta) < 0.05 then 2 else 1 end"
_MOVED = f"select *, {_TIER} tier from (select ticker, b.weight - h.weight delta, gain from fx_best b join fx_held h using(ticker))"


def _rebalanced(spark, d):
    """The holdings against the optimiser's weights; selling a winner is taxed."""
    return A.rebalance(_held(spark, d), O.optimal(_al(spark, d), _region_mu(spark, d)), F.col("gain") & (F.col("delta") < 0))


@query("k_rebalance", f"select ticker, delta, tier, row_number() over (order by tier, round(abs(delta), 9) desc, ticker) place from ({_MOVED})", d="delta", i="tier place")
def _(spark, d):
    return _rebalanced(spark, d).select("ticker", "delta", "tier", "place")


_MARG = "(0.005+0.01*k)"
_MVOL = f"sqrt((1-{_MARG})*(1-{_MARG})*vp+{_MARG}*{_MARG}*v+2*{_MARG}*(1-{_MARG})*c+1e-8)"


fx.SQL["fx_marginal"] = f"""with p as (select dt, sum(weight*ret) p from fx_returns join {_W} using(ticker) group by 1),
    s as (select ticker, avg(ret)*252 m, avg(p)*252 mp, var_samp(ret)*252 v, var_samp(p)*252 vp, covar_samp(ret, p)*252 c, corr(ret, p) corr from fx_returns join p using(dt) group by 1 having count(*) >= 60),
    g as (select *, ((1-{_MARG})*mp+{_MARG}*m-0.035)/{_MVOL} sh, {_MVOL} vol from s cross join (select unnest(range(31)) k))
    select ticker, {_MARG} weight, sh-(mp-0.035)/sqrt(vp) d_sharpe, vol-sqrt(vp) d_vol, corr from g qualify row_number() over (partition by ticker order by sh desc, k desc) = 1"""


def _marginal(spark, d):
    r = fx.returns(spark, d)
    return O.marginal(r, J.weighted_sum(r, _weights(spark, d)), r.select("ticker").distinct())


@query("k_marginal", "select * from fx_marginal", d="weight d_sharpe d_vol corr", digits=4)
def _(spark, d):
    return _marginal(spark, d)


_FITTED = " + ".join(f"beta_{f}*{f}" for f in R.FACTORS)
_EMAX = f"((1-{_G})*{_ppf_of('1-1/20.0::double')} + {_G}*{_ppf_of('1-1/(20.0::double*2.718281828459045::double)')})/sqrt(n)"
fx.SQL["fx_moments"] = f"select ticker, any_value(n) n, any_value(alpha/sigma) ir_d, case when count(*) > 3 then avg(z^3) else 0 end g3, case when count(*) > 3 then avg(z^4) else 3 end g4 from (select *, (y - alpha - ({_FITTED}))/sigma z from ({_YEAR}) join fx_fit5 using(ticker) where sigma > 0) group by 1"
fx.SQL["fx_agreed"] = "select ticker, count(*) n_windows, any_value(majority) majority, count(*) filter (s = majority) consistency from (select *, sign(sum(s) over (partition by ticker)) majority from (select ticker, case when abs(t_alpha) > 1.5 then sign(t_alpha) end s from fx_multi5)) group by 1"
fx.SQL["fx_oos"] = f"select ticker, case when count(*) >= 2 then avg(((alpha > 0) = (ahead > 0))::int) end oos from fx_roll5 join (select ticker, w, avg(y) ahead from ({_windows(147)}) where pos >= 126 group by 1, 2) using(ticker, w) group by 1"
fx.SQL["fx_psr"] = f"select ticker, n, ir_d, 0.5*case when x >= 0 then e else 2 - e end psr, (ir_d - {_EMAX})*sqrt(252) deflated from (select *, t*exp(-x*x + {_ERFC}) e from (select *, 1/(1+0.5*abs(x)) t from (select *, -ir_d*sqrt(n-1)/sqrt(v)/sqrt(2.0::double) x from (select *, case when 1-g3*ir_d+(g4-1)/4*ir_d*ir_d > 0 then 1-g3*ir_d+(g4-1)/4*ir_d*ir_d end v from fx_moments))))"
fx.SQL["fx_robust"] = """select *, case when psr > 0.85 and consistency >= 2 and majority > 0 and (oos is null or oos > 0.52) and deflated > 0 then 'BUY'
    when psr < 0.15 and consistency >= 2 and majority < 0 and (oos is null or oos < 0.48) and deflated < 0 then 'SELL' else 'HOLD' end robust from (select ticker, n, ir_d, psr, deflated, coalesce(n_windows, 0) n_windows, coalesce(consistency, 0) consistency, coalesce(majority, 0) majority, oos from fx_psr left join fx_agreed using(ticker) left join fx_oos using(ticker))"""


@query("k_robust", "select * from fx_robust", d="ir_d psr deflated majority oos", i="n n_windows consistency")
def _(spark, d):
    return R.robust_signal(fx.aligned(spark, d))


_CAPS = """with recursive turns(k, names, w) as (select 0, list(ticker order by ticker), list(ir/t order by ticker) from (select ticker, ir, sum(ir) over () t from fx_fit5 where ir > 0)
    union all select k + 1, names, list_transform(w, lambda x: case when much < 1e-12 or room < 1e-12 then least(x, 0.2::double) when x > 0.2 then 0.2::double else x + much*(0.2::double - x)/room end)
    from (select *, list_sum(list_transform(w, lambda x: greatest(x - 0.2::double, 0))) much, list_sum(list_transform(w, lambda x: greatest(0.2::double - x, 0))) room from turns where k < 30))
    select unnest(names) ticker, unnest(list_transform(w, lambda x: x/list_sum(w))) weight from turns where k = 30"""


@query("k_signal_weights", _CAPS, d="weight")
def _(spark, d):
    return _signal_weights(spark, d)


@query("k_walk_forward")
def _(spark, d):
    return walk_forward(fx.aligned(spark, d))


@query("k_experiment")
def _(spark, d):
    rows = fx.aligned(spark, d).withColumn("mom", F.lag("ret", 21).over(X.by())).filter("mom is not null")
    one = F.lit(1)
    summed = None
    for name, factors in (("five", R.FACTORS), ("six", (*R.FACTORS, "mom"))):
        alphas = R.window_alphas(rows, factors, 126, 21).select("ticker", "w", "alpha")
        ahead = X.window_ids(rows, 126, 21, 147).filter("pos >= 126").groupBy("ticker", "w").agg(F.sum("y").alias("z"))
        ic = R.ic_summary(R.spearman(alphas.join(ahead, ["ticker", "w"]), "w", "alpha", "z").filter("n > 4")).withColumn("spec", F.lit(name)).withColumn("k", one).drop("k")
        summed = ic if summed is None else summed.unionByName(ic)
    return summed


_BT = """with s as (select ticker, dt, close, coalesce(last_value(case when entry then 1 when exit then 0 end ignore nulls) over (partition by ticker order by dt), 0) st from fx_cross),
w as (select *, coalesce(lag(st) over (partition by ticker order by dt), 0) was, lag(close) over (partition by ticker order by dt) pc, count(*) over (partition by ticker) c from s),
r as (select *, case when was = 1 then close/pc-1 else 0 end ret, sum(case when st = 1 and was = 0 then 1 else 0 end) over (partition by ticker order by dt) tr from w where c >= 60),
m as (select *, exp(sum(ln(1+ret)) over (partition by ticker order by dt)) cum from r),
q as (select *, cum/max(cum) over (partition by ticker order by dt)-1 dd from m),
t as (select ticker, count(*) trades, avg((g > 0)::int) win_rate from (select ticker, tr, sum(ln(1+ret)) g from r where was = 1 group by 1, 2) group by 1)
select q.ticker, 252*avg(ret) ann_ret, sqrt(252)*avg(ret)/nullif(stddev_samp(ret), 0) sharpe, min(dd) max_drawdown, 10000*arg_max(cum, dt) equity, any_value(trades) trades, any_value(win_rate) win_rate from q left join t using(ticker) group by 1"""


@query("k_sma_backtest", _BT, d="ann_ret sharpe max_drawdown equity win_rate", i="trades", digits=5)
def _(spark, d):
    return V.crossover_backtest(fx.prices(spark, d))


@query("k_indicators", "select ticker, dt, close, sma20, bb_upper from (select ticker, dt, close, avg(close) over w sma20, avg(close) over w + 2*stddev_pop(close) over w bb_upper, count(*) over (partition by ticker) c from fx_p300 window w as (partition by ticker order by dt rows between 19 preceding and current row)) where c >= 30 qualify row_number() over (partition by ticker order by dt desc) = 1", d="close sma20 bb_upper", digits=5)
def _(spark, d):
    return I.bundle(fx.prices(spark, d)).select("ticker", "dt", "close", "sma20", "bb_upper")


_RULES = (
    "case when sma50 <> 0 and sma200 <> 0 then case when sma50 > sma200 then 1.0 else -1.0 end end",
    "case when close <> 0 and sma20 <> 0 then case when close > sma20 then 0.5 else -0.5 end end",
    "case when macd is not null and macd_signal is not null then case when macd > macd_signal then 1.0 else -1.0 end end",
    "case when rsi14 < 30 then 1.5 when rsi14 > 70 then -1.5 when rsi14 is not null then 0.0 end",
    "case when sma20 - 2*dev <> 0 and sma20 + 2*dev <> 0 then case when close <= sma20 - 2*dev then 1.0 when close >= sma20 + 2*dev then -1.0 end end",
    "case when volume <> 0 and volume_sma10 <> 0 and volume / volume_sma10 > 1.5 then 0.5 end",
)
_SIG = f"select ticker, {' + '.join(f'({r} is not null)::int' for r in ('r1', 'r2', 'r3', 'r4', 'r5', 'r6'))} n, {' + '.join(f'coalesce({r}, 0)' for r in ('r1', 'r2', 'r3', 'r4', 'r5', 'r6'))} t from (select ticker, {', '.join(f'{x} r{k}' for k, x in enumerate(_RULES, 1))} from fx_last)"


@query("k_signals", f"select ticker, case when n > 0 then t / n else 0 end score from ({_SIG})", d="score")
def _(spark, d):
    return I.scored(I.bundle(fx.prices(spark, d))).select("ticker", "score")


# ---------------------------------------------------------------- stress

_HS = "(values ('A', date '1995-03-01', date '1995-06-30', -0.56::double, 0.08::double, 0.04::double), ('B', date '1996-02-01', date '1996-03-31', -0.34, 0.06, -0.02), ('C', date '1997-10-20', date '1997-10-20', -0.22, 0.02, 0.01)) s(scenario, s, e, be, bo, go)"
SCENARIOS = (("A", "1995-03-01", "1995-06-30", -0.56, 0.08, 0.04), ("B", "1996-02-01", "1996-03-31", -0.34, 0.06, -0.02), ("C", "1997-10-20", "1997-10-20", -0.22, 0.02, 0.01))
fx.SQL["fx_betas"] = "select r.ticker, case when count(*) >= 21 then covar_samp(r.ret, e.ret)/var_samp(e.ret) end beta from fx_returns r join fx_returns_region e on e.dt = r.dt and e.ticker = 'EUROPE' group by 1"
_HIST = f"select scenario, sum(weight*coalesce(actual, case asset_class when 'bond' then bo when 'gold' then go else be*coalesce(nullif(beta, 0), 1) end)) pct_loss, sum(case when actual is not null then weight else 0 end) coverage from fx_eur left join fx_betas using(ticker) cross join {_HS} left join (select scenario sc, ticker tk, arg_max(close, dt)/arg_min(close, dt)-1 actual from fx_prices join {_HS} on dt between s and e group by 1, 2 having count(*) >= 2) on sc = scenario and tk = ticker group by 1"


def _hist(spark, d):
    betas = M.beta(J.with_benchmark(fx.returns(spark, d), fx.returns_region(spark, d).filter("ticker = 'EUROPE'")))
    return T.historical(fx.holdings_eur(spark, d), fx.prices(spark, d), betas, SCENARIOS)


@query("st_hist", _HIST, d="pct_loss coverage")
def _(spark, d):
    return _hist(spark, d)


_HYPO = "select s scenario, sum(weight*case asset_class when 'equity' then e*1.1 when 'bond' then b when 'gold' then g else 0 end) pct_loss from fx_eur cross join (values ('Rates +200bps', -0.04::double, -0.12::double, -0.03::double), ('USD +15%', -0.08, -0.02, -0.10), ('USD -15%', 0.05, 0.01, 0.08), ('Oil -50%', -0.05, 0.01, -0.02), ('Tech Sector -30%', -0.18, 0, 0)) t(s, e, b, g) group by 1 union all select 'Single Pos Gap -40%', max(weight)*-0.4 from fx_eur"


@query("st_hypo", _HYPO, d="pct_loss")
def _(spark, d):
    return T.hypothetical(fx.holdings_eur(spark, d), 1.1)


_ALL = f"select 'historical' kind, scenario, pct_loss from ({_HIST}) union all select 'hypothetical', scenario, pct_loss from ({_HYPO})"


@query("st_all", _ALL, d="pct_loss")
def _(spark, d):
    return T.everything(_hist(spark, d), T.hypothetical(fx.holdings_eur(spark, d), 1.1))


# ---------------------------------------------------------------- paper trading


@query("pt_expand", "with h as (select ticker from fx_watchlist) select ticker, 'permanent' origin from h union all select * from (select ticker, 'sample' from (select distinct p_brand ticker from part) where ticker not in (select ticker from h) order by md5(concat(ticker, '1998-09-01')) limit 2)")
def _(spark, d):
    w = fx.watchlist(spark, d)
    pool = fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker"))
    return A.expand_universe(w, pool, "1998-09-01", w.count() + 2)


@query("pt_screen", "select ticker, ir, case when t_alpha > 1.5 then 'BUY' when t_alpha < -1.5 then 'SELL' else 'HOLD' end signal, psr, robust from fx_fit5 join fx_robust using(ticker)", d="ir psr")
def _(spark, d):
    fits = R.factor_regression(fx.aligned(spark, d)).select("ticker", "ir", "signal")
    return fits.join(R.robust_signal(fx.aligned(spark, d)).select("ticker", "psr", "robust"), "ticker").orderBy(F.desc_nulls_last("ir"))


_SCREEN = "select ticker, robust from fx_robust"


def _screen(spark, d):
    return R.robust_signal(fx.aligned(spark, d)).select("ticker", "robust")


@query("pt_promote", f"select ticker, robust from ({_SCREEN}) where robust <> 'HOLD' and ticker not in (select ticker from fx_watchlist)")
def _(spark, d):
    return A.promote(_screen(spark, d), fx.watchlist(spark, d))


@query("pt_prune", f"select ticker, rule, rule is null keep from (select w.ticker, case when notes = 'manual' then null when robust = 'SELL' then 'A' when robust <> 'BUY' and date '1998-12-31' - cast(regexp_extract(notes, '\\[(.*)\\]', 1) as date) > 30 then 'B' end rule from fx_watchlist w left join ({_SCREEN}) s using(ticker))")
def _(spark, d):
    out = A.prune(fx.watchlist(spark, d), _screen(spark, d), F.lit("1998-12-31").cast("date"))
    return out.select("ticker", "rule", "keep")


_PR = "select dt, sum(weight*ret) ret from fx_al join fx_rw using(ticker) group by 1"
_PCF = f"select case when count(*) >= 21 then -{_CF}*sd end v from (select skewness(ret) s, kurtosis(ret) k, stddev_samp(ret) sd, count(*) n from p), p group by s, k, sd"


@query("pt_risk", f"with p as ({_PR}) select coalesce((select v from ({_PCF})), 1.6449*sqrt((select sum(x.weight*y.weight*cov) from fx_ewcov join fx_rw x on x.ticker=a join fx_rw y on y.ticker=b))) var_95, (select case when count(*) >= 21 then covar_samp(p.ret, e.ret)/var_samp(e.ret) end from p join fx_al e on e.dt=p.dt and e.ticker='EUROPE') beta, (select sum(weight*weight) from fx_rw) hhi", d="var_95 beta hhi")
def _(spark, d):
    r, w = _al(spark, d), _region_weights(spark)
    one = F.lit(1)
    port = J.weighted_sum(r, w).withColumn("ticker", F.lit("P"))
    normal = M.quadratic_form(w, M.ewma_covariances(r)).select((M.Z95 * F.col("sigma")).alias("normal"), one.alias("k"))
    var = M.cornish_fisher_var(port).select("var_cf", one.alias("k")).join(normal, "k", "right").select("k", F.coalesce("var_cf", "normal").alias("var_95"))
    beta = M.beta(J.with_benchmark(port, r.filter("ticker = 'EUROPE'"))).select("beta", one.alias("k"))
    return var.join(beta, "k").join(P.concentration(w).select("hhi", one.alias("k")), "k").drop("k")


#: Each platform's portfolio and the paper one of regions: what it earned over the last 252 rows of its tickers, and what the gates ask of it.
fx.SQL["fx_books"] = "select platform, ticker, sum(market_value_eur)/sum(sum(market_value_eur)) over (partition by platform) weight from fx_eur group by 1, 2 union all select 'PAPER', ticker, weight from fx_rw"
fx.SQL["fx_book_rets"] = "select platform, dt, sum(weight*ret) ret from (select *, row_number() over (partition by ticker order by dt desc) rn from (select * from fx_returns union all select * from fx_returns_region)) join fx_books using(ticker) where rn <= 252 group by 1, 2"
fx.SQL["fx_gates"] = """select platform, positions, var_95, beta, drawdown, case when positions > 10 then 'positions' when var_95 > 0.05 then 'var' when beta > 1.5 then 'beta' when drawdown > 0.1 then 'drawdown' else 'ok' end gate
    from (select platform, count(*) positions from fx_books group by 1) join (select platform, -quantile_cont(ret, 0.05) var_95 from fx_book_rets group by 1) using(platform)
    left join (select platform, case when count(*) >= 21 then covar_samp(p.ret, e.ret)/var_samp(e.ret) end beta from fx_book_rets p join fx_returns_region e on e.dt = p.dt and e.ticker = 'EUROPE' group by 1) using(platform)
    join (select platform, -min(cum/peak-1) drawdown from (select platform, cum, max(cum) over (partition by platform order by dt) peak from (select platform, dt, exp(sum(ln(1+ret)) over (partition by platform order by dt)) cum from fx_book_rets)) group by 1) using(platform)"""


def _gates(spark, d):
    h = fx.holdings_eur(spark, d).groupBy("platform", "ticker").agg(F.sum("market_value_eur").alias("mv"))
    books = h.withColumn("weight", F.col("mv") / F.sum("mv").over(W.partitionBy("platform")))
    books = books.select("platform", "ticker", "weight").unionByName(_region_weights(spark).withColumn("platform", F.lit("PAPER")))
    rets = X.tail(fx.returns(spark, d).unionByName(fx.returns_region(spark, d)), 252).join(books, "ticker").groupBy("platform", "dt").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret")).withColumnRenamed("platform", "ticker")
    rets = written(rets, "books")
    parts = [books.groupBy(F.col("platform").alias("ticker")).agg(F.count("*").alias("positions")), M.historical_var(rets, (0.95,)), X.drawdown(rets).groupBy("ticker").agg((-F.min("drawdown")).alias("drawdown"))]
    out = M.beta(J.with_benchmark(rets, fx.returns_region(spark, d).filter("ticker = 'EUROPE'")))
    for p in parts:
        out = p.join(out, "ticker", "left")
    return out.select(F.col("ticker").alias("platform"), "positions", "var_95", "beta", "drawdown", A.gate(F.col("positions"), F.col("var_95"), F.col("beta"), F.col("drawdown")).alias("gate"))


@query("pt_gates", "select * from fx_gates", d="var_95 beta drawdown", i="positions")
def _(spark, d):
    return _gates(spark, d)


#: Positions with their gain, and the signals of their regression and of the robust rule.
fx.SQL["fx_signals"] = "select ticker, ir, case when t_alpha > 1.5 then 'BUY' when t_alpha < -1.5 then 'SELL' else 'HOLD' end signal, robust from fx_fit5 join fx_robust using(ticker)"
fx.SQL["fx_exits"] = """with h as (select ticker, sum(market_value_eur)/sum(cost_basis_eur)-1 plpc from fx_eur group by 1), s as (select ticker from fx_signals where signal = 'SELL' or robust = 'SELL')
    select ticker, 'signal' reason from h where ticker in (select ticker from s) union all select ticker, 'stop_loss' from h where plpc < -0.15 and ticker not in (select ticker from s)"""
_SIZED = "select ticker, ir, least(greatest(coalesce(ir, 0), 0.01)/sum(greatest(coalesce(ir, 0), 0.01)) over (), 0.15) weight from fx_signals where signal = 'BUY' and robust <> 'SELL'"


def _signals(spark, d):
    fits = R.factor_regression(fx.aligned(spark, d)).select("ticker", "ir", "signal")
    return fits.join(_screen(spark, d), "ticker")


def _positions(spark, d):
    sums = fx.holdings_eur(spark, d).groupBy("ticker").agg(F.sum("quantity").alias("quantity"), F.sum("market_value_eur").alias("mv"), F.sum("cost_basis_eur").alias("cost"))
    return sums.withColumn("plpc", F.col("mv") / F.col("cost") - 1)


def _buys(signals):
    return A.order_weights(signals.filter("signal = 'BUY' and robust <> 'SELL'"))


@query("pt_exits", "select * from fx_exits")
def _(spark, d):
    return A.exits(_positions(spark, d), _signals(spark, d))


@query("pt_size", f"select ticker, weight from ({_SIZED})", d="weight")
def _(spark, d):
    return _buys(_signals(spark, d)).select("ticker", "weight")


#: Orders of one rebalancing in falling ir: whole shares within the equity that is left (the fold of ``budget_fold``).
_ORDERS = f"""with recursive b as (select row_number() over (order by ir desc nulls last, ticker) place, ticker, weight, price from ({_SIZED}) join (select ticker, arg_max(close, dt) price from fx_prices group by 1) using(ticker) where ticker not in (select ticker from fx_exits)),
    f(place, left_, ticker, qty, amount) as (select 0::bigint, 100000.0::double, null::varchar, 0.0::double, 0.0::double union all
    select b.place, case when q >= 1 then left_ - q*price else left_ end, b.ticker, q, q*price from (select b.*, f.left_, floor(least(100000.0*b.weight, f.left_)/b.price) q from f join b on b.place = f.place + 1) b)
    select 'sell' side, ticker, sum(quantity) qty, sum(market_value_eur) as value, any_value(reason) reason from fx_eur join fx_exits using(ticker) group by 2
    union all select 'buy', ticker, qty, amount, 'signal' from f where qty >= 1 and (select bool_or(gate = 'ok') from fx_gates)"""


@query("pt_pipeline", _ORDERS, d="qty value", digits=4)
def _(spark, d):
    signals = written(_signals(spark, d), "signals")
    held = _positions(spark, d)
    out = A.exits(held, signals)
    sells = held.join(out, "ticker").select(F.lit("sell").alias("side"), "ticker", "quantity", F.col("mv").alias("value"), "reason")
    last = fx.prices(spark, d).groupBy("ticker").agg(F.max_by("close", "dt").alias("price"))
    book = _buys(signals).join(out, "ticker", "left_anti").join(last, "ticker").withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("ir"), "ticker")))
    open_ = _gates(spark, d).agg(F.bool_or(F.col("gate") == "ok").alias("open"))  # one row: if any book may grow
    buys = A.budget_fold(book.select("place", "ticker", "weight", "price"), 100_000).crossJoin(open_).filter("open")
    return sells.unionByName(buys.select(F.lit("buy").alias("side"), "ticker", F.col("qty").cast("double").alias("quantity"), "value", F.lit("signal").alias("reason"))).withColumnRenamed("quantity", "qty")


_CARD_COLUMNS = ("nav_eur", "var_95", "cvar", "cvar_ratio", "var_95_cf", "sharpe", "max_drawdown", "daily_loss", "beta", "hhi", "max_position")


def _card_sql(rows: str = "select * from fx_returns", bench: str = "select * from fx_returns_region") -> str:
    return f"""with p as materialized (select dt, sum(weight*ret) ret from (select *, row_number() over (partition by ticker order by dt desc) rn from ({rows})) join {_W} using(ticker) where rn <= 252 group by 1),
    q as (select quantile_cont(ret, 0.05) q, skewness(ret) s, kurtosis(ret) k, stddev_samp(ret) sd, avg(ret) m, count(*) n, arg_max(ret, dt) last from p),
    dd as (select min(cum/peak-1) dd from (select cum, max(cum) over (order by dt) peak from (select dt, exp(sum(ln(1+ret)) over (order by dt)) cum from p))),
    b as (select covar_samp(p.ret, e.ret)/var_samp(e.ret) beta, count(*) n from p join ({bench}) e on e.dt = p.dt and e.ticker = 'EUROPE'),
    h as (select sum(market_value_eur) nav_eur, sum(weight*weight) hhi, max(weight) max_position from fx_eur), c as (select -avg(ret) cvar from p, q where ret <= q.q)
    select round(nav_eur, 2) nav_eur, -q.q var_95, cvar, cvar/-q.q cvar_ratio, case when q.n >= 21 then -{_CF}*sd end var_95_cf, case when q.n >= 21 and sd > 0 then (252*m-0.035)/(sqrt(252)*sd) end sharpe, -dd max_drawdown, -last daily_loss, case when b.n >= 21 then beta end beta, hhi, max_position from q, dd, b, h, c"""


def _card(spark, d, days: int = 0):
    """The card of the holdings, over the returns up to ``days`` before the last one."""
    r, bench = fx.returns(spark, d), fx.returns_region(spark, d).filter("ticker = 'EUROPE'")
    if days:
        last = r.agg(F.date_sub(F.max("dt"), days).alias("_until"))  # one row
        r, bench = (x.join(F.broadcast(last), F.col("dt") <= F.col("_until")).drop("_until") for x in (r, bench))
    return Q.risk_card(r, fx.holdings_eur(spark, d), bench).withColumn("nav_eur", F.round("nav_eur", 2)).select(*_CARD_COLUMNS)


_THRESHOLDS = {m: (t, how) for m, t, how in Q.THRESHOLDS}


def _check_sql() -> str:
    """Every metric of the card against its threshold."""
    names, limits = ", ".join(repr(m) for m in _THRESHOLDS), ", ".join(f"{t}::double" for t, _ in _THRESHOLDS.values())
    below = ", ".join(repr(m) for m, (_, how) in _THRESHOLDS.items() if how == "below")
    return f"select metric, value, threshold, case when value is null then 'GREY' when (metric not in ({below}) and value > threshold) or (metric in ({below}) and value < threshold) then 'RED' else 'GREEN' end status from (select unnest([{names}]) metric, unnest([{', '.join(_THRESHOLDS)}]) as value, unnest([{limits}]) threshold from ({_card_sql()}))"


def _alerts(spark, d):
    return Q.alerts(_card(spark, d))


_CHECK = _check_sql()


@query("al_check", f"select * from ({_CHECK}) where status = 'RED'", d="value threshold")
def _(spark, d):
    return _alerts(spark, d).filter("status = 'RED'")


@query("cls_rag", f"select metric, status, max(status = 'RED') over () breached from ({_CHECK})")
def _(spark, d):
    return _alerts(spark, d).select("metric", "status", F.max(F.col("status") == "RED").over(P.every()).alias("breached"))


# ---------------------------------------------------------------- service tables


@query("svc_poll", "select event_type ticker, arg_max(value, ts) price, max(ts) ts from events where dayofweek(ts) between 1 and 5 and hour(ts)*60+minute(ts) between 870 and 1260 and value is not null group by 1", d="price")
def _(spark, d):
    ticks = P.market_hours(fx.table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("value").alias("price"), "ts"))
    return B.latest_prices(ticks)


@query("svc_runs", "select run_id, arg_max(status, \"at\") status, max(\"at\") changed, count(*) n from (select user_id run_id, ts as at, case event_type when 'click' then 'success' when 'view' then 'running' else 'failed' end status from events) group by 1 having arg_max(status, \"at\") = 'success'", i="run_id n")
def _(spark, d):
    r = runs(spark, d).groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("changed"), F.count("*").alias("n"))
    return r.filter("status = 'success'")


@query("db_recent", "select id, dt, recommendation from fx_suggestions where dt >= date '1998-05-01'", i="id")
def _(spark, d):
    return fx.suggestions(spark, d).filter("dt >= date'1998-05-01'").orderBy(F.desc("dt")).select("id", "dt", "recommendation")


@query("db_uneval", "select id, dt from fx_suggestions where dt <= date '1998-05-01' and accurate is null", i="id")
def _(spark, d):
    return fx.suggestions(spark, d).filter("dt <= date'1998-05-01' and accurate is null").select("id", "dt")


@query("db_snapshots", "select event_type ticker, arg_max(value, ts) price, max(ts) ts from events group by 1", d="price")
def _(spark, d):
    ticks = fx.table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("value").alias("price"), "ts")
    return B.latest_prices(ticks).orderBy("ticker")


# ---------------------------------------------------------------- streams (batch twins and streams that run to their end)


@query("str_parse", "select event_type ticker, value price, cast(user_id as double) volume, cast(event_id as bigint) ms from events where event_id % 3 <> 0", d="price volume", i="ms")
def _(spark, d):
    m = F.struct(F.when(F.col("event_id") % 3 == 0, "status").otherwise("AM").alias("ev"), F.col("event_type").alias("sym"), F.col("value").alias("c"), F.col("user_id").cast("double").alias("v"), F.col("event_id").alias("t"))
    raw = fx.table(spark, d, "events").groupBy((F.col("event_id") % 50).alias("g")).agg(F.to_json(F.collect_list(m)).alias("value"))
    broken = spark.createDataFrame([("{broken",), ("[]",)], "value string")
    parsed = B.parse_events(raw.select("value").unionByName(broken))
    return parsed.select("ticker", "price", "volume", F.unix_millis("ts").alias("ms"))


@query("str_on_bar", "select event_type ticker, arg_max(value, ts) price, max(ts) ts from events group by 1", d="price")
def _(spark, d):
    from tideline.plans.scratch import folder

    schema = fx.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ticks = stream.select(F.col("event_type").alias("ticker"), F.col("value").alias("price"), "ts")
    base = folder(spark)
    q = B.start_latest(ticks, f"{base}/latest", f"{base}/log")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    kinds = B.latest_prices(fx.table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("value").alias("price"), "ts")).schema
    return spark.read.schema(kinds).parquet(f"{base}/latest/v{q.lastProgress['batchId']}")


def _ran(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def _dealt(spark, d, base, start):
    """Runs the query that ``start`` starts on a stream over the events with even ids, then from its checkpoint over those with odd ids: two epochs."""
    e = fx.table(spark, d, "events").select("event_id", F.col("event_type").alias("ticker"), F.col("value").alias("price"), "ts")
    for k in range(2):
        e.filter(F.pmod("event_id", F.lit(2)) == k).write.parquet(f"{base}/feed/part={k}")
        q = _ran(start(spark.readStream.schema(e.schema).parquet(f"{base}/feed/part=*")))
    return q


#: Watchlist versions of the two batches (fixed values).
WATCHED = ((0, "click"), (0, "view"), (1, "view"), (1, "purchase"))
_RELOAD = "select event_type ticker, arg_max(value, ts) price, max(ts) ts from events where value is not null and ((event_id % 2 = 0 and event_type in ('click', 'view')) or (event_id % 2 = 1 and event_type in ('view', 'purchase'))) group by 1"


@query("str_reload", _RELOAD, d="price")
def _(spark, d):
    from tideline.plans.scratch import folder

    base = folder(spark)
    spark.createDataFrame(WATCHED, "version long, ticker string").write.parquet(f"{base}/watchlist")
    q = _dealt(spark, d, base, lambda stream: L.start_watched(stream.select("ticker", "price", "ts"), f"{base}/watchlist", f"{base}/latest", f"{base}/log"))
    kinds = B.latest_prices(fx.table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("value").alias("price"), "ts")).schema
    return spark.read.schema(kinds).parquet(f"{base}/latest/v{q.lastProgress['batchId']}")


_PUSHED = "select receiver, event_id % 2 epoch, event_type ticker, arg_max(value, ts) price from events, (select unnest(['first', 'second']) receiver) where value is not null group by all"


@query("str_broadcast", _PUSHED, d="price", i="epoch")
def _(spark, d):
    import os

    from tideline.plans.scratch import folder

    base = folder(spark)
    here = base.removeprefix("file://")
    names = ["first", "second", "missing"]  # the third has no folder: it is dropped
    for n in names[:2]:
        os.makedirs(f"{here}/{n}")
    _dealt(spark, d, base, lambda stream: L.push_prices(stream, f"{here}/sent", [f"{here}/{n}" for n in names], f"{base}/log"))
    sent = spark.read.schema("epoch long, prices array<struct<ticker: string, price: double>>").json([f"{base}/{n}" for n in names[:2]])
    rows = sent.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("receiver"), "epoch", F.explode("prices").alias("p"))
    return rows.select("receiver", "epoch", "p.ticker", "p.price")


@query("str_bars", "select ticker, ts, open, high, low, close, volume from fx_bars_h", d="open high low close", i="volume")
def _(spark, d):
    return fx.bars_h(spark, d)


_DAY = "list_reduce(list_transform(list_sort(list(ts)), lambda t: [t]), lambda sent, t: case when t[1] - sent[len(sent)] >= interval 24 hours then list_concat(sent, t) else sent end)"


@query("str_alert_dedup", f"select key, unnest({_DAY}) ts from (select event_type || cast(user_id as varchar) key, ts from events where ts is not null) group by 1")
def _(spark, d):
    from tideline.plans.scratch import folder

    base, schema = folder(spark), fx.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    alerts = stream.select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), "ts")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.STORE)
    try:
        _ran(L.alerts_once(alerts).writeStream.format("parquet").option("path", f"{base}/sent").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema("key string, ts timestamp").parquet(f"{base}/sent").select("key", F.col("ts").cast(schema["ts"].dataType).alias("ts"))


# ---------------------------------------------------------------- report sections

_EQ = "select ticker, sum(market_value_eur) mv from fx_eur where asset_class='{0}' group by 1 order by round(sum(market_value_eur), 2) desc, 1 limit 10"


@query("rep_alerts", f"select metric, value, threshold, status from ({_CHECK}) where status = 'RED'", d="value threshold")
def _(spark, d):
    return _alerts(spark, d).filter("status = 'RED'")


@query("rep_snapshot", "select sum(market_value_eur) nav_eur, sum(market_value_eur)-sum(cost_basis_eur) pnl_eur, count(distinct ticker) tickers from fx_eur", d="nav_eur pnl_eur", i="tickers", digits=2)
def _(spark, d):
    h = fx.holdings_eur(spark, d)
    one = F.lit(1)
    return P.nav(h).select("nav_eur", "pnl_eur", one.alias("k")).join(h.agg(F.count_distinct("ticker").alias("tickers")).withColumn("k", one), "k").drop("k")


@query("rep_stress", f"select * from ({_ALL}) order by round(pct_loss, 9), scenario limit 3", d="pct_loss")
def _(spark, d):
    return T.worst(T.everything(_hist(spark, d), T.hypothetical(fx.holdings_eur(spark, d), 1.1)))


def _metrics_sql(card: str) -> str:
    return f"select unnest([{', '.join(repr(c) for c in _CARD_COLUMNS)}]) metric, unnest([{', '.join(_CARD_COLUMNS)}]) v from ({card})"


_UNTIL = "(select cast(max(dt) as date) - 7 from fx_returns)"
_BEFORE = _card_sql(f"select * from fx_returns where dt <= {_UNTIL}", f"select * from fx_returns_region where dt <= {_UNTIL}")


@query("rep_indicators", f"select metric, n.v as value, b.v as before, n.v - b.v change from ({_metrics_sql(_card_sql())}) n join ({_metrics_sql(_BEFORE)}) b using(metric)", d="value before change")
def _(spark, d):
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in _CARD_COLUMNS]))
    return Q.beside(_card(spark, d).select(cells), _card(spark, d, 7).select(cells))


_EXPO = f"select factor, sum(weight*beta)/sum(weight) beta, sqrt(sum((weight*se)^2))/sum(weight) se from (select ticker, unnest([{', '.join(repr(f) for f in R.FACTORS)}]) factor, unnest([{', '.join(f'beta_{f}' for f in R.FACTORS)}]) beta, unnest([{', '.join(f'se_{f}' for f in R.FACTORS)}]) se from fx_fit5 where beta_{R.FACTORS[0]} is not null) join {_W} w using(ticker) group by 1"


@query("rep_exposure", _EXPO, d="beta se")
def _(spark, d):
    fits = R.factor_regression(fx.aligned(spark, d))
    card = R.portfolio_exposure(fits, _weights(spark, d), tuple(f"beta_{f}" for f in R.FACTORS), tuple(f"se_{f}" for f in R.FACTORS))
    return card.select(F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"beta_{f}").alias("beta"), F.col(f"se_{f}").alias("se")) for f in R.FACTORS])))


@query("rep_attribution", f"select factor, sum(contrib) contrib from ({_attr(21)}) group by 1", d="contrib", digits=5)
def _(spark, d):
    return _attribution(spark, d, 21).groupBy("factor").agg(F.sum("contrib").alias("contrib"))


@query("rep_quality", "select count(alpha) fits, avg(r2) mean_r2, count(*) filter (abs(t_alpha) > 1.5) significant from fx_fit5", d="mean_r2", i="fits significant")
def _(spark, d):
    return R.factor_regression(fx.aligned(spark, d)).agg(F.count("alpha").alias("fits"), F.avg("r2").alias("mean_r2"), F.count_if(F.abs("t_alpha") > 1.5).alias("significant"))


@query("rep_rankings", "select ticker, ir, row_number() over (order by round(ir, 6) desc nulls last, ticker) place from fx_fit5", d="ir", i="place")
def _(spark, d):
    fits = R.factor_regression(fx.aligned(spark, d)).select("ticker", "ir")
    return Q.ranked(fits, F.round("ir", 6).desc_nulls_last(), F.col("ticker"))


def _signal_weights(spark, d):
    return A.capped_weights(R.factor_regression(fx.aligned(spark, d)).filter("ir > 0").select("ticker", F.col("ir").alias("score")))


@query("rep_signal_weights", f"select ticker, weight from ({_CAPS})", d="weight", digits=4)
def _(spark, d):
    return _signal_weights(spark, d)


@query("rep_rebalancing", f"select ticker, delta, tier, case tier when 3 then 'Hold' when 2 then 'Watch' else 'Act' end action, case when delta > 0 then 'Add' else 'Cut' end direction from ({_MOVED})", d="delta", i="tier")
def _(spark, d):
    action = F.when(F.col("tier") == 3, "Hold").when(F.col("tier") == 2, "Watch").otherwise("Act")
    return _rebalanced(spark, d).select("ticker", "delta", "tier", action.alias("action"), F.when(F.col("delta") > 0, "Add").otherwise("Cut").alias("direction"))


@query("rep_candidates", "select ticker, case when weight > 0.006 and round(d_sharpe, 6) > 0 then 'add' when weight > 0.006 then 'neutral' else 'skip' end verdict from fx_marginal where ticker not in (select ticker from fx_watchlist)")
def _(spark, d):
    gains = _marginal(spark, d).join(fx.watchlist(spark, d), "ticker", "left_anti")
    return gains.select("ticker", A.candidate_verdict(F.col("weight"), F.round("d_sharpe", 6)).alias("verdict"))


@query("rep_top10", _EQ.format("equity"), d="mv", digits=2)
def _(spark, d):
    return Q.top_positions(fx.holdings_eur(spark, d))


@query("rep_bonds", _EQ.format("bond"), d="mv", digits=2)
def _(spark, d):
    return Q.top_positions(fx.holdings_eur(spark, d), asset_class="bond")


@query("rep_montecarlo")
def _(spark, d):
    return C.tail_metrics(written(_simulated(spark, d, "garch"), "paths")).select("var_95", "cvar_95", "p_loss_5", "dd_mean")


@query("rep_corr_break", _BREAK, d="sigma sigma_break ratio")
def _(spark, d):
    return T.correlation_break(_region_weights(spark), M.ewma_covariances(_al(spark, d)))


@query("rep_footer", "select ticker, concat('[', count(*), 'd window]') flag from fx_prices group by 1 having count(*) >= 21 and count(*) < 1400")
def _(spark, d):
    return Q.flagged(P.classify_series(fx.prices(spark, d), 1400)).select("ticker", "flag")


@query("risk_card", _card_sql(), d=" ".join(_CARD_COLUMNS))
def _(spark, d):
    return _card(spark, d)


@query("sink_html")
def _(spark, d):
    page = Q.html("Risk report", {"Alerts": _alerts(spark, d), "Top positions": Q.top_positions(fx.holdings_eur(spark, d))})
    return spark.createDataFrame([(len(page) > 500, "Top positions" in page)], "written boolean, has_positions boolean")


@query("src_ws", "select event_type ticker, count(*) n from events group by 1", i="n")
def _(spark, d):
    from tideline.plans.scratch import folder
    from tideline.sources.services import pushed_events

    base = folder(spark)
    m = F.struct(F.lit("AM").alias("ev"), F.col("event_type").alias("sym"), F.col("value").alias("c"), F.col("user_id").cast("double").alias("v"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    fx.table(spark, d, "events").groupBy((F.col("event_id") % 20).alias("g")).agg(F.to_json(F.collect_list(m)).alias("value")).select("value").write.text(f"{base}/feed")
    q = B.parse_events(pushed_events(spark, f"{base}/feed")).writeStream.format("parquet").option("path", f"{base}/bars").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("ticker string, price double, volume double, ts timestamp").parquet(f"{base}/bars").groupBy("ticker").agg(F.count("*").alias("n"))
