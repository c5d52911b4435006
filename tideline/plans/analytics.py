"""Queries of aggregations, window functions, recursions and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import allocation as A
from tideline.operators import factors as R
from tideline.operators import joins as J
from tideline.operators import moments as M
from tideline.operators import portfolio as P
from tideline.operators import series as X
from tideline.operators import stress as T
from tideline.plans import fixtures as fx
from tideline.plans import least_squares as L
from tideline.plans.registry import query

_W = "(select ticker, sum(weight) weight from fx_eur group by 1)"
_LAST = "(select *, row_number() over (partition by ticker order by dt desc) rn, row_number() over (partition by ticker order by dt) r, count(*) over (partition by ticker) c from fx_returns)"
_RW = "(select 'AFRICA' ticker, 0.3::double weight union all select 'AMERICA', 0.25 union all select 'ASIA', 0.2 union all select 'EUROPE', 0.15 union all select 'MIDDLE EAST', 0.1)"
REGION_WEIGHTS = [("AFRICA", 0.3), ("AMERICA", 0.25), ("ASIA", 0.2), ("EUROPE", 0.15), ("MIDDLE EAST", 0.1)]
_SKEW = "skewness({0})"
_PORT = f"select dt, sum(weight*ret) ret from {_LAST} join {_W} using(ticker) where rn <= 252 group by 1"


def _weights(spark, d):
    return P.by_ticker(fx.holdings_eur(spark, d))


def _region_weights(spark):
    return spark.createDataFrame(REGION_WEIGHTS, "ticker string, weight double")


def _port(spark, d):
    return J.weighted_sum(X.tail(fx.returns(spark, d), 252), _weights(spark, d)).withColumn("ticker", F.lit("P"))


@query("agg_weight_by_ticker", "select ticker, sum(weight) weight from fx_eur group by 1", d="weight", digits=9)
def _(spark, d):
    return _weights(spark, d)


@query("agg_mv_by_ticker", "select ticker, sum(market_value_eur) market_value_eur, arg_min(asset_class, platform) asset_class, arg_min(currency, platform) currency from fx_eur group by 1", d="market_value_eur", digits=2)
def _(spark, d):
    return P.value_by_ticker(fx.holdings_eur(spark, d))


@query("agg_class_weights", "select asset_class, sum(weight) weight from fx_eur group by 1", d="weight", digits=9)
def _(spark, d):
    return T.class_weights(fx.holdings_eur(spark, d))


@query("agg_nav", "select sum(market_value_eur) nav_eur, sum(cost_basis_eur) cost_eur, sum(market_value_eur)-sum(cost_basis_eur) pnl_eur, sum(market_value_eur) filter (asset_class='bond') bond_eur, sum(market_value_eur) filter (asset_class='bond')/sum(market_value_eur) bond_pct from fx_eur", d="nav_eur cost_eur pnl_eur bond_eur bond_pct", digits=2)
def _(spark, d):
    return P.nav(fx.holdings_eur(spark, d))


@query("agg_hhi", "select sum(weight*weight) hhi from fx_eur", d="hhi", digits=9)
def _(spark, d):
    return P.concentration(fx.holdings_eur(spark, d)).select("hhi")


@query("agg_maxpos", "select max(weight) max_position from fx_eur", d="max_position", digits=9)
def _(spark, d):
    return P.concentration(fx.holdings_eur(spark, d)).select("max_position")


@query("agg_port_ret", _PORT, d="ret")
def _(spark, d):
    return _port(spark, d).select("dt", "ret")


@query("agg_sharpe", "select ticker, case when count(*) >= 21 and stddev_samp(ret) > 0 then (252*avg(ret)-0.035)/(sqrt(252)*stddev_samp(ret)) end sharpe from fx_returns group by 1", d="sharpe")
def _(spark, d):
    return M.sharpe(fx.returns(spark, d))


@query("agg_beta", "select r.ticker, covar_samp(r.ret, b.ret)/var_samp(b.ret) beta from fx_returns_region r join fx_returns_region b on r.dt=b.dt and b.ticker='EUROPE' group by 1 having count(*) >= 21", d="beta")
def _(spark, d):
    r = fx.returns_region(spark, d)
    return M.beta(J.with_benchmark(r, r.filter("ticker = 'EUROPE'"))).filter("beta is not null")


@query("agg_var_hist", "select ticker, -quantile_cont(ret, 0.05) var_95, -quantile_cont(ret, 0.01) var_99 from fx_returns group by 1", d="var_95 var_99")
def _(spark, d):
    return M.historical_var(fx.returns(spark, d))


@query("agg_cvar", "select ticker, -avg(ret) cvar from fx_returns r join (select ticker t, quantile_cont(ret, 0.05) q from fx_returns group by 1) on t = ticker where ret <= q group by 1", d="cvar")
def _(spark, d):
    return M.cvar(fx.returns(spark, d))


@query("agg_skew_kurt", "select ticker, skewness(ret) skew, kurtosis(ret) kurt from fx_returns group by 1", d="skew kurt")
def _(spark, d):
    return fx.returns(spark, d).groupBy("ticker").agg(M.skew("ret").alias("skew"), M.kurtosis("ret").alias("kurt"))


_Z = "(-1.6448536269514722::double)"
_CF = f"({_Z} + ({_Z}*{_Z}-1)*s/6 + ({_Z}*{_Z}*{_Z}-3*{_Z})*k/24 - (2*{_Z}*{_Z}*{_Z}-5*{_Z})*s*s/36)"


@query("agg_cf_var", f"select ticker, -{_CF}*sd var_cf from (select ticker, skewness(ret) s, kurtosis(ret) k, stddev_samp(ret) sd from fx_returns group by 1 having count(*) >= 21)", d="var_cf")
def _(spark, d):
    return M.cornish_fisher_var(fx.returns(spark, d)).filter("var_cf is not null")


_EW = "select a.ticker a, b.ticker b, sum(w*a.ret*b.ret) - sum(w*a.ret)*sum(w*b.ret) cov from (select dt, pow(0.94, age)/sum(pow(0.94, age)) over () w from (select dt, row_number() over (order by dt desc)-1 age from fx_al group by 1)) t join fx_al a using(dt) join fx_al b using(dt) group by 1, 2"
fx.SQL["fx_al"] = "select ticker, dt, ret from fx_returns_region where dt in (select dt from fx_returns_region group by 1 having count(*) = 5)"
fx.SQL["fx_ewcov"] = _EW
fx.SQL["fx_cov"] = "select a.ticker a, b.ticker b, covar_samp(a.ret, b.ret)*252 cov, corr(a.ret, b.ret) corr from fx_al a join fx_al b using(dt) group by 1, 2"
fx.SQL["fx_rw"] = f"select * from {_RW}"


def _al(spark, d):
    return J.align_inner(fx.returns_region(spark, d), 5)


@query("agg_ewma_cov", "select a, b, cov from fx_ewcov", d="cov", digits=9)
def _(spark, d):
    return M.ewma_covariances(_al(spark, d))


@query("agg_cov", "select a, b, cov, corr from fx_cov", d="cov corr")
def _(spark, d):
    return M.covariances(_al(spark, d))


@query("agg_corr", "select a.ticker a, b.ticker b, corr(a.ret, b.ret) corr from (select *, row_number() over (partition by ticker order by dt desc) rn from fx_al) a join fx_al b using(dt) where a.rn <= 63 and a.ticker < b.ticker group by 1, 2", d="corr")
def _(spark, d):
    return M.pairs(X.tail(_al(spark, d), 63)).groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


_SIGMA = "select sqrt(sum(x.weight*y.weight*cov)) sigma from fx_cov join fx_rw x on x.ticker=a join fx_rw y on y.ticker=b"


@query("agg_quadform", _SIGMA, d="sigma")
def _(spark, d):
    return M.quadratic_form(_region_weights(spark), M.covariances(_al(spark, d)))


@query("agg_component_var", "select ticker, weight, 1.6449*m/sigma marginal, weight*1.6449*m/sigma component, weight*m/sum(weight*m) over () pct from (select *, sqrt(sum(weight*m) over ()) sigma from (select x.ticker, x.weight, sum(y.weight*cov) m from fx_ewcov join fx_rw x on x.ticker=a join fx_rw y on y.ticker=b group by 1, 2))", d="weight marginal component pct")
def _(spark, d):
    return M.component_var(_region_weights(spark), M.ewma_covariances(_al(spark, d)))


_OLS1 = "select ticker, count(*) n, regr_intercept(y, mkt_rf) alpha, regr_slope(y, mkt_rf) beta, regr_r2(y, mkt_rf) r2, sqrt(greatest(regr_syy(y,mkt_rf)-regr_sxy(y,mkt_rf)^2/regr_sxx(y,mkt_rf),0)/(count(*)-2)/regr_sxx(y,mkt_rf)) se from fx_aligned group by 1 having count(*) >= 63"


@query("agg_ols1", f"select *, case when se > 1e-12 then beta/se end t_beta from ({_OLS1})", d="alpha beta r2 se t_beta", i="n")
def _(spark, d):
    return R.single_factor(fx.aligned(spark, d))


_YEAR = "select * from fx_aligned qualify row_number() over (partition by ticker order by dt desc) <= 252"
fx.SQL["fx_fit5"] = L.regression(_YEAR)


@query("agg_ols5", "select *, alpha*252 alpha_ann, case when t_alpha > 1.5 then 'BUY' when t_alpha < -1.5 then 'SELL' else 'HOLD' end signal, case when abs(t_alpha) >= 3 then '★★★' when abs(t_alpha) >= 2 then '★★' when abs(t_alpha) >= 1.5 then '★' else '' end stars from fx_fit5", d=L.columns() + " alpha_ann", i="n")
def _(spark, d):
    return R.factor_regression(fx.aligned(spark, d))


_BETAS = "select ticker, regr_slope(y, mkt_rf) mkt_rf, regr_slope(y, smb) smb, regr_slope(y, hml) hml from fx_aligned group by 1"


def _betas(spark, d):
    return fx.aligned(spark, d).groupBy("ticker").agg(*[F.regr_slope("y", f).alias(f) for f in ("mkt_rf", "smb", "hml")])


@query("agg_port_exposure", f"select sum(weight) used, sum(weight*mkt_rf)/sum(weight) mkt_rf, sum(weight*smb)/sum(weight) smb, sqrt(sum((weight*hml)^2))/sum(weight) hml from {_W} w join ({_BETAS}) b using(ticker)", d="used mkt_rf smb hml")
def _(spark, d):
    return R.portfolio_exposure(_betas(spark, d), _weights(spark, d), ("mkt_rf", "smb"), ("hml",))


def _attr(rows):
    return f"""with b as (select ticker, unnest(['mkt_rf','smb','hml']) factor, unnest([mkt_rf, smb, hml]) beta from ({_BETAS})),
    s as (select ticker, unnest(['mkt_rf','smb','hml']) factor, unnest([m, s, h]) factor_ret, total, rf_sum from (select ticker, sum(ret) total, sum(rf) rf_sum, sum(mkt_rf) m, sum(smb) s, sum(hml) h from (select *, row_number() over (partition by ticker order by dt desc) rn from fx_aligned) where rn <= {rows} group by 1 having count(*) >= 5))
    select ticker, factor, beta, factor_ret, beta*factor_ret contrib, case when abs(total) > 1e-10 then beta*factor_ret/total end pct_of_total, total, total - rf_sum - sum(beta*factor_ret) over (partition by ticker) alpha from s join b using(ticker, factor)"""


def _attribution(spark, d, rows):
    return R.attribution(fx.aligned(spark, d), _betas(spark, d), ("mkt_rf", "smb", "hml"), rows)


@query("agg_attribution", _attr(21), d="beta factor_ret contrib pct_of_total total alpha", digits=5)
def _(spark, d):
    return _attribution(spark, d, 21)


@query("agg_stock_attribution", f"select ticker, arg_max(factor, (round(abs(pct_of_total), 9), factor)) dominant, any_value(alpha) alpha from ({_attr(63)}) group by 1", d="alpha")
def _(spark, d):
    return R.dominant(_attribution(spark, d, 63))


@query("agg_vif", L.vifs("select * from fx_factors"), d="vif")
def _(spark, d):
    return R.vif(fx.factors(spark, d)).select("factor", "vif")


@query("agg_condnum", L.condition("select * from fx_factors"), d="cond")
def _(spark, d):
    return R.vif(fx.factors(spark, d)).agg(F.max("cond").alias("cond"))


@query("agg_high_pairs", "select a, b, corr from (select unnest(['mkt_rf','mkt_rf','smb','cma']) a, unnest(['smb','hml','hml','rmw']) b, unnest([corr(mkt_rf,smb), corr(mkt_rf,hml), corr(smb,hml), corr(cma,rmw)]) corr from fx_factors) where abs(corr) > 0.005 and a <> 'cma'", d="corr")
def _(spark, d):
    return R.high_pairs(fx.factors(spark, d), ("mkt_rf", "smb", "hml"), 0.005)


_RECENT = "select * from fx_factors order by dt desc limit 252"
_PAIRS = " + ".join(f"(abs(corr({a}, {b})) > 0.4)::int" for k, a in enumerate(L.FACTORS) for b in L.FACTORS[k + 1 :])


@query("agg_collinearity", f"select *, n >= 30 and (max_vif > 5 or cond > 10 or high_pairs > 0) has_warning from (select (select max(vif) from ({L.vifs(_RECENT)})) max_vif, (select cond from ({L.condition(_RECENT)})) cond, {_PAIRS} high_pairs, count(*) n from ({_RECENT}))", d="max_vif cond", i="high_pairs n")
def _(spark, d):
    return R.collinearity(fx.factors(spark, d))


fx.SQL["fx_ic"] = "select w, ticker, x, z from (select ticker, w, sum(ret) filter (pos < 126) x, sum(ret) filter (pos >= 126) z from (select ticker, ret, w, r-1-w*21 pos, c from (select ticker, dt, ret, unnest(range(greatest(0, cast(ceil((r-147)/21.0) as bigint)), (r-1)//21 + 1)) w, r, c from (select *, row_number() over (partition by ticker order by dt) r, count(*) over (partition by ticker) c from fx_returns)) where w*21+147 <= c) group by 1, 2)"
_IC = "select w, count(*) n, 1-6*sum((rx-ry)^2)/(count(*)*(count(*)*count(*)-1.0)) ic from (select w, row_number() over (partition by w order by round(x,9), ticker) rx, row_number() over (partition by w order by round(z,9), ticker) ry from fx_ic) group by 1 having count(*) > 1"


def _ic_rows(spark, d):
    win = X.window_ids(fx.returns(spark, d), 126, 21, 147).groupBy("w", "ticker")
    return win.agg(F.round(F.sum(F.when(F.col("pos") < 126, F.col("ret"))), 9).alias("x"), F.round(F.sum(F.when(F.col("pos") >= 126, F.col("ret"))), 9).alias("z"))


def _ics(spark, d):
    return R.spearman(_ic_rows(spark, d), "w", "x", "z").filter("n > 1")


@query("agg_spearman_ic", _IC, d="ic", i="w n")
def _(spark, d):
    return _ics(spark, d)


@query("agg_ic_summary", f"select count(ic) periods, avg(ic) mean_ic, stddev_samp(ic) sd_ic, case when count(ic) >= 2 then avg(ic)/(stddev_samp(ic)/sqrt(count(ic))) end t, case when count(ic) >= 2 then avg(ic)/stddev_samp(ic)*sqrt(252/21) end icir from ({_IC})", d="mean_ic sd_ic t icir", i="periods")
def _(spark, d):
    return R.ic_summary(_ics(spark, d)).drop("p")


@query("agg_hit_rate", "select ticker, case when count(*) >= 2 then avg(case when (x > 0) = (z > 0) then 1 else 0 end) end hit_rate from fx_ic group by 1", d="hit_rate")
def _(spark, d):
    hit = F.avg(((F.col("x") > 0) == (F.col("z") > 0)).cast("int"))
    return _ic_rows(spark, d).groupBy("ticker").agg(F.when(F.count("*") >= 2, hit).alias("hit_rate"))


_MOM = "select * from (select *, lag(ret, 21) over (partition by ticker order by dt) mom from fx_aligned) where mom is not null"


@query("agg_dr2", f"select count(*) n, avg(s.r2 - f.r2) mean_dr2, median(s.r2 - f.r2) median_dr2, avg(abs(t_mom)) mean_t, avg((abs(t_mom) > 2)::int) share_t2 from ({L.regression(_MOM)}) f join ({L.regression(_MOM, factors=(*L.FACTORS, 'mom'))}) s using(ticker) where f.r2 is not null and s.r2 is not null", d="mean_dr2 median_dr2 mean_t share_t2", i="n")
def _(spark, d):
    rows = fx.aligned(spark, d).withColumn("mom", F.lag("ret", 21).over(X.by())).filter("mom is not null")
    return R.added_r2(R.regress(rows), R.regress(rows, (*R.FACTORS, "mom")), "mom")


fx.SQL["fx_ewma"] = "select ticker, dt, ret, r, c, case when c < 21 then vall else pow(0.94, r-1)*v0 + coalesce(0.06*pow(0.94, r-2)*sum(ret*ret*pow(0.94, -(r-1))) over (partition by ticker order by dt rows between unbounded preceding and 1 preceding), 0) end var from (select *, var_pop(ret) over (partition by ticker) vall, var_pop(case when r <= 21 then ret end) over (partition by ticker) v0 from (select *, row_number() over (partition by ticker order by dt) r, count(*) over (partition by ticker) c from fx_returns))"
fx.SQL["fx_breach"] = "select ticker, dt, ret, ret < -1.6449*sqrt(pv) breach from (select *, lag(var) over (partition by ticker order by dt) pv from fx_ewma) where r > 21 and pv > 0"


def _breaches(spark, d):
    v = X.numbered(X.ewma_variance(fx.returns(spark, d)), "r").withColumn("pv", F.lag("var").over(X.by()))
    return v.filter("r > 21 and pv > 0").select("ticker", "dt", "ret", (F.col("ret") < -M.Z95 * F.sqrt("pv")).alias("breach"))


@query("agg_exceptions", "select ticker, count(*) n, sum(breach::int) x, sum(breach::int)/count(*) rate, count(*)*0.05 expected from fx_breach group by 1", d="rate expected", i="n x")
def _(spark, d):
    return M.coverage_tests(_breaches(spark, d)).select("ticker", "n", "x", "rate", "expected")


_TR = "select ticker, count(*) n, sum(b) x, count(*) filter (l=0 and b=0) n00, count(*) filter (l=0 and b=1) n01, count(*) filter (l=1 and b=0) n10, count(*) filter (l=1 and b=1) n11 from (select ticker, breach::int b, lag(breach::int) over (partition by ticker order by dt) l from fx_breach) group by 1"


@query("agg_transitions", f"select ticker, n00, n01, n10, n11 from ({_TR})", i="n00 n01 n10 n11")
def _(spark, d):
    return M.coverage_tests(_breaches(spark, d)).select("ticker", "n00", "n01", "n10", "n11")


def _xl(x, y):
    return f"(case when {y} > 0 then {x}*ln({y}) else 0 end)"


_UC = f"greatest(-2*((n-x)*ln(0.95)+x*ln(0.05)-{_xl('(n-x)', '(1-x/n)')}-{_xl('x', '(x/n)')}), 0)"


@query("agg_kupiec", f"select ticker, {_UC} lr_uc from ({_TR})", d="lr_uc")
def _(spark, d):
    return M.coverage_tests(_breaches(spark, d)).select("ticker", "lr_uc")


_P = "select *, coalesce(n01/nullif(n00+n01,0),0) p01, coalesce(n11/nullif(n10+n11,0),0) p11, coalesce((n01+n11)/nullif(n00+n01+n10+n11,0),0) pi from (" + _TR + ")"
_IND = f"greatest(-2*({_xl('(n00+n10)', '(1-pi)')}+{_xl('(n01+n11)', 'pi')}-{_xl('n00', '(1-p01)')}-{_xl('n01', 'p01')}-{_xl('n10', '(1-p11)')}-{_xl('n11', 'p11')}), 0)"


@query("agg_christoffersen", f"select ticker, {_IND} lr_ind, {_UC}+{_IND} lr_cc, exp(-({_UC}+{_IND})/2) p_cc from ({_P})", d="lr_ind lr_cc p_cc")
def _(spark, d):
    return M.coverage_tests(_breaches(spark, d)).select("ticker", "lr_ind", "lr_cc", "p_cc")


@query("agg_accuracy", "select recommendation, count(*) n, sum(accurate) hits, sum(accurate)/count(*) accuracy from fx_suggestions where accurate is not null group by 1", d="accuracy", i="n hits")
def _(spark, d):
    done = fx.suggestions(spark, d).filter("accurate is not null")
    return done.groupBy("recommendation").agg(F.count("*").alias("n"), F.sum("accurate").alias("hits"), (F.sum("accurate") / F.count("*")).alias("accuracy"))


fx.SQL["fx_wf"] = "select w, avg(z)*252/21 a, avg(x)*252/126 h, count(*) n from fx_ic group by 1"


@query("agg_wf_summary", "select count(*) windows, avg(a) mean_a, avg(h) mean_h, avg(a-h) delta, avg((a > h)::int) win_rate from fx_wf", d="mean_a mean_h delta win_rate", i="windows")
def _(spark, d):
    from tideline.operators.walk import summary

    w = _ic_rows(spark, d).groupBy("w").agg((F.avg("z") * 252 / 21).alias("a"), (F.avg("x") * 252 / 126).alias("h"))
    return summary(w, "a", "h").toDF("windows", "mean_a", "mean_h", "delta", "win_rate")


_DD = "select ticker, dt, ret, cum, cum/max(cum) over (partition by ticker order by dt)-1 drawdown from (select ticker, dt, ret, exp(sum(ln(1+ret)) over (partition by ticker order by dt)) cum from fx_returns)"


@query("agg_oos_metrics", f"select ticker, 252*avg(ret) ann_ret, sqrt(252)*stddev_pop(ret) ann_vol, case when stddev_pop(ret)*sqrt(252) > 1e-9 then (252*avg(ret)-0.035)/(sqrt(252)*stddev_pop(ret)) else 0 end sharpe, min(drawdown) max_drawdown from ({_DD}) group by 1", d="ann_ret ann_vol sharpe max_drawdown")
def _(spark, d):
    from tideline.operators.walk import oos_metrics

    return oos_metrics(fx.returns(spark, d))


@query("agg_liquidity", "select ticker, platform, quantity, adv from fx_holdings join (select ticker, avg(volume) adv from (select *, row_number() over (partition by ticker order by dt desc) rn from fx_prices) where rn <= 3 group by 1) using(ticker) where quantity > 5*adv", d="quantity adv")
def _(spark, d):
    return T.illiquid(fx.holdings(spark, d), fx.prices(spark, d)).select("ticker", "platform", "quantity", "adv")


_WW = "select w, ticker, abs(x)/sum(abs(x)) over (partition by w) weight from fx_ic"


def _window_weights(spark, d):
    return _ic_rows(spark, d).withColumn("weight", F.abs("x") / F.sum(F.abs("x")).over(W.partitionBy("w")))


@query("agg_turnover", f"with q as ({_WW}) select w, case when w = (select min(w) from q) then 1.0 else t end turnover from (select w, sum(abs(a-b))/2 t from (select coalesce(a.w, b.w+1) w, coalesce(a.weight, 0) a, coalesce(b.weight, 0) b from q a full join q b on a.w = b.w+1 and a.ticker = b.ticker) group by 1) where w <= (select max(w) from q)", d="turnover", i="w")
def _(spark, d):
    return A.turnover(_window_weights(spark, d))


_TOP = "select w, ticker, row_number() over (partition by w order by round(x,9) desc, ticker) place from fx_ic"


def _top(spark, d):
    return _ic_rows(spark, d).withColumn("place", F.row_number().over(W.partitionBy("w").orderBy(F.desc("x"), "ticker")))


@query("agg_topk_turnover", f"with t as ({_TOP} qualify place <= 5) select a.w, 1-count(b.ticker)/5.0 turnover from t a left join t b on b.w = a.w-1 and b.ticker = a.ticker where a.w > (select min(w) from t) group by 1", d="turnover", i="w")
def _(spark, d):
    return A.topk_turnover(_top(spark, d), "w", 5)


# ---------------------------------------------------------------- windows


@query("win_lag_return", "select ticker, dt, close/lag(close) over (partition by ticker order by dt)-1 ret from fx_prices_region qualify ret is not null", d="ret")
def _(spark, d):
    return X.simple_returns(fx.prices_region(spark, d)).select("ticker", "dt", "ret")


@query("win_tail_n", "select ticker, dt, close from fx_prices qualify row_number() over (partition by ticker order by dt desc) <= 20", d="close")
def _(spark, d):
    return X.tail(fx.prices(spark, d), 20).select("ticker", "dt", "close")


def _full(expr, n):
    return f"case when row_number() over (partition by ticker order by dt) >= {n} then {expr} over (partition by ticker order by dt rows between {n - 1} preceding and current row) end"


@query("win_sma", f"select ticker, dt, {_full('avg(close)', 20)} sma20, {_full('avg(close)', 50)} sma50, {_full('avg(close)', 200)} sma200, {_full('avg(volume)', 10)} volume_sma10 from fx_prices", d="sma20 sma50 sma200 volume_sma10", digits=9)
def _(spark, d):
    return X.moving_averages(fx.prices(spark, d)).select("ticker", "dt", "sma20", "sma50", "sma200", "volume_sma10")


@query("win_bb", f"select ticker, dt, {_full('avg(close)', 20)} bb_mid, {_full('avg(close)', 20)} + 2*({_full('stddev_pop(close)', 20)}) bb_upper, {_full('avg(close)', 20)} - 2*({_full('stddev_pop(close)', 20)}) bb_lower from fx_prices", d="bb_mid bb_upper bb_lower", digits=8)
def _(spark, d):
    return X.bollinger(fx.prices(spark, d)).select("ticker", "dt", "bb_mid", "bb_upper", "bb_lower")


def _ema(src, value, alpha, out, least, keep="ticker, dt"):
    """Recursion as a closed form: x0 d^t + a sum x_k d^(t-k), with the sum anchored at each row by logs of d."""
    dec = 1 - alpha
    return f"select {keep}, case when r >= {least} then v end {out} from (select *, pow({dec!r}, r-1) * sum(case when r = 1 then {value} else {alpha!r}*{value} end * pow({dec!r}, 1-r)) over (partition by ticker order by dt) v from (select *, row_number() over (partition by ticker order by dt) r from {src}))"


fx.SQL["fx_p300"] = "select * from fx_prices"
fx.SQL["fx_macd"] = f"select ticker, dt, f-s macd from ({_ema('fx_p300', 'close', 2 / 13, 'f', 12)}) join ({_ema('fx_p300', 'close', 2 / 27, 's', 26)}) using(ticker, dt)"


@query("win_ema", f"select m.ticker, m.dt, ema20, macd, macd_signal, macd - macd_signal macd_hist from fx_macd m join ({_ema('fx_p300', 'close', 2 / 21, 'ema20', 20)}) e using(ticker, dt) left join ({_ema('(select * from fx_macd where macd is not null)', 'macd', 0.2, 'macd_signal', 9)}) s using(ticker, dt)", d="ema20 macd macd_signal macd_hist", digits=5)
def _(spark, d):
    return X.macd(X.ema(fx.prices(spark, d), "close", 20, "ema20")).select("ticker", "dt", "ema20", "macd", "macd_signal", "macd_hist")


fx.SQL["fx_moves"] = "select ticker, dt, coalesce(greatest(s, 0), 0) up, coalesce(greatest(-s, 0), 0) down from (select *, close-lag(close) over (partition by ticker order by dt) s from fx_p300)"


@query("win_rsi", f"select ticker, dt, case when g is null then null when l = 0 then 100.0 else 100-100/(1+g/l) end rsi14 from ({_ema('fx_moves', 'up', 1 / 14, 'g', 14)}) join ({_ema('fx_moves', 'down', 1 / 14, 'l', 14)}) using(ticker, dt)", d="rsi14", digits=5)
def _(spark, d):
    return X.rsi(fx.prices(spark, d)).select("ticker", "dt", "rsi14")


_LAST = ", ".join(f"{_full('avg(close)', n)} sma{n}" for n in (20, 50, 200)) + f", {_full('avg(volume)', 10)} volume_sma10, {_full('stddev_pop(close)', 20)} dev"
_RSI = f"select ticker, dt, case when g is null then null when l = 0 then 100.0 else 100-100/(1+g/l) end rsi14 from ({_ema('fx_moves', 'up', 1 / 14, 'g', 14)}) join ({_ema('fx_moves', 'down', 1 / 14, 'l', 14)}) using(ticker, dt)"
fx.SQL["fx_last"] = (
    f"select * from (select ticker, dt, close, volume, {_LAST}, count(*) over (partition by ticker) c from fx_prices) left join fx_macd using(ticker, dt) left join ({_ema('(select * from fx_macd where macd is not null)', 'macd', 0.2, 'macd_signal', 9)}) using(ticker, dt) "
    f"left join ({_RSI}) using(ticker, dt) where c >= 30 qualify row_number() over (partition by ticker order by dt desc) = 1"
)


fx.SQL["fx_tr"] = "select ticker, dt, r, coalesce(greatest(high-low, abs(high-pc), abs(low-pc)), high-low) tr from (select *, lag(close) over (partition by ticker order by dt) pc, row_number() over (partition by ticker order by dt) r from fx_bars_d)"
fx.SQL["fx_trs"] = "select ticker, dt, case when r = 14 then m else tr end x from (select *, avg(tr) over (partition by ticker order by dt rows between 13 preceding and current row) m from fx_tr) where r >= 14"


@query("win_atr", f"select t.ticker, t.dt, t.tr, atr14 from fx_tr t left join ({_ema('fx_trs', 'x', 1 / 14, 'atr14', 1)}) a using(ticker, dt)", d="tr atr14", digits=5)
def _(spark, d):
    return X.atr(fx.bars_d(spark, d)).select("ticker", "dt", "tr", "atr14")


fx.SQL["fx_cross"] = "select ticker, dt, close, coalesce(f > s and pf <= ps, false) entry, coalesce(f < s and pf >= ps, false) exit from (select *, lag(f) over (partition by ticker order by dt) pf, lag(s) over (partition by ticker order by dt) ps from (select ticker, dt, close, " + _full("avg(close)", 20) + " f, " + _full("avg(close)", 50) + " s from fx_prices))"


@query("win_cross", "select ticker, dt, entry, exit from fx_cross where entry or exit")
def _(spark, d):
    return X.crossings(fx.prices(spark, d)).filter("entry or exit").select("ticker", "dt", "entry", "exit")


@query("win_ewma_var", "select ticker, dt, var*10000 var from fx_ewma", d="var")
def _(spark, d):
    return X.ewma_variance(fx.returns(spark, d)).select("ticker", "dt", (F.col("var") * 10000).alias("var"))


@query("win_ewma_var_last", "select ticker, 1.6449*sqrt(arg_max(var, dt)) var_95, 2.3263*sqrt(arg_max(var, dt)) var_99 from fx_ewma group by 1", d="var_95 var_99")
def _(spark, d):
    sd = F.sqrt(F.max_by("var", "dt"))
    return X.ewma_variance(fx.returns(spark, d)).groupBy("ticker").agg((M.Z95 * sd).alias("var_95"), (M.Z99 * sd).alias("var_99"))


@query("win_drawdown", f"select ticker, dt, cum, drawdown from ({_DD})", d="cum drawdown")
def _(spark, d):
    return X.drawdown(fx.returns(spark, d)).select("ticker", "dt", "cum", "drawdown")


fx.SQL["fx_paths"] = "select o_custkey path, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) step, (o_totalprice - 200000)/4000000 ret from orders"


def paths(spark, d):
    o = fx.table(spark, d, "orders")
    step = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_custkey").alias("path"), step.alias("step"), ((F.col("o_totalprice") - 200000) / 4000000).alias("ret"))


fx.SQL["fx_nav"] = "select path, step, ret, exp(sum(ln(1+ret)) over (partition by path order by step)) nav from fx_paths"


@query("win_drawdown_nav", "select path, min(nav/greatest(1, peak)-1) drawdown from (select *, max(nav) over (partition by path order by step) peak from fx_nav) group by 1", d="drawdown", i="path", digits=5)
def _(spark, d):
    from tideline.operators.montecarlo import nav_paths, path_drawdown

    return path_drawdown(nav_paths(paths(spark, d)))


@query("win_var_backtest", "select ticker, dt, ret, n_before, case when n_before > 3 then sk else 0 end skew, case when n_before > 3 then ku else 0 end kurt from (select ticker, dt, ret, count(*) over w n_before, skewness(ret) over w sk, kurtosis(ret) over w ku from fx_returns window w as (partition by ticker order by dt rows between 252 preceding and 1 preceding))", d="ret skew kurt", i="n_before", digits=4)
def _(spark, d):
    return X.trailing_moments(fx.returns(spark, d)).select("ticker", "dt", "ret", "n_before", "skew", "kurt")


def _windows(span):
    """Aligned rows in each window of ``span`` rows that the series holds whole, a window every 21 rows."""
    rows = "(select *, row_number() over (partition by ticker order by dt) r, count(*) over (partition by ticker) c from fx_aligned)"
    return f"select * from (select *, r-1-w*21 pos from (select *, unnest(range(greatest(0, cast(ceil((r-{span})/21.0) as bigint)), (r-1)//21 + 1)) w from {rows})) where w*21+{span} <= c"


fx.SQL["fx_roll5"] = L.regression(_windows(126), "ticker, w", least=126)


@query("win_roll_ols", "select * from fx_roll5", d=L.columns(), i="w n")
def _(spark, d):
    return R.window_alphas(fx.aligned(spark, d), R.FACTORS)


_MULTI = "select * from (select *, unnest([63, 126, 252]) win from (select *, row_number() over (partition by ticker order by dt desc) rn, count(*) over (partition by ticker) c from fx_aligned)) where rn <= win and c >= win"
fx.SQL["fx_multi5"] = L.regression(_MULTI, "ticker, win")


@query("win_multi", "select * from fx_multi5", d=L.columns(), i="win n")
def _(spark, d):
    return R.multi_window(fx.aligned(spark, d))


@query("win_eval_grid", "select ticker, dt, cast(r as bigint) rn from (select ticker, dt, row_number() over (partition by ticker order by dt) r, count(*) over (partition by ticker) c from fx_returns where ticker = (select min(ticker) from fx_returns)) where (c - r + 1) % 21 = 0 and (c - r + 1)//21 between 1 and 8 and r > 126", i="rn")
def _(spark, d):
    from tideline.operators.walk import eval_grid

    return eval_grid(fx.returns(spark, d), 126, 21, 8)


@query("win_wf_grid", "select w, ticker, n from (select w, ticker, count(*) filter (pos < 126) n from (select ticker, w, r-1-w*21 pos, c from (select ticker, unnest(range(greatest(0, cast(ceil((r-147)/21.0) as bigint)), (r-1)//21 + 1)) w, r, c from (select *, row_number() over (partition by ticker order by dt) r, count(*) over (partition by ticker) c from fx_returns)) where w*21+147 <= c) group by 1, 2) where n >= 100", i="w n")
def _(spark, d):
    win = X.window_ids(fx.returns(spark, d), 126, 21, 147)
    return win.groupBy("w", "ticker").agg(F.count_if(F.col("pos") < 126).alias("n")).filter("n >= 100")


@query("win_ffill0", "select t.ticker, c.dt, coalesce(last_value(r.ret ignore nulls) over (partition by t.ticker order by c.dt), 0) ret from (select distinct dt from fx_returns_region) c cross join (select distinct ticker from fx_returns_region) t left join fx_returns_region r on r.ticker=t.ticker and r.dt=c.dt", d="ret", digits=9)
def _(spark, d):
    r = fx.returns_region(spark, d)
    tickers = r.select("ticker").distinct().agg(F.collect_set("ticker").alias("t"))
    spine = r.select("dt").distinct().join(F.broadcast(tickers)).select(F.explode("t").alias("ticker"), "dt")
    return X.forward_filled(spine, r).select("ticker", "dt", "ret")


@query("win_rank_ic", "select w, ticker, row_number() over (partition by w order by round(x,9), ticker) rx, row_number() over (partition by w order by round(z,9), ticker) ry from fx_ic", i="w rx ry")
def _(spark, d):
    w = W.partitionBy("w")
    return _ic_rows(spark, d).select("w", "ticker", F.row_number().over(w.orderBy("x", "ticker")).alias("rx"), F.row_number().over(w.orderBy("z", "ticker")).alias("ry"))


_BOOK = f"select row_number() over (order by weight desc, ticker) place, ticker, weight*2 weight, price from {_W} join (select ticker, arg_max(close, dt) price from fx_prices group by 1) using(ticker)"
_RUN = f"""with recursive book as materialized ({_BOOK}), run(place, ticker, qty, value, rest) as (select 0::bigint, ''::varchar, 0::bigint, 0.0::double, 100000.0::double
    union all select place, ticker, qty, qty*price, case when qty >= 1 then rest - qty*price else rest end from (select b.place, b.ticker, b.price, rest, cast(floor(least(100000.0*b.weight, rest)/b.price) as bigint) qty from run join book b on b.place = run.place + 1))
    select ticker, qty, value from run where qty >= 1"""


@query("win_capital_run", _RUN, d="value", i="qty")
def _(spark, d):
    last = fx.prices(spark, d).groupBy("ticker").agg(F.max_by("close", "dt").alias("price"))
    orders = _weights(spark, d).join(last, "ticker").withColumn("place", F.row_number().over(W.orderBy(F.desc("weight"), "ticker")))
    return A.budget_fold(orders.select("place", "ticker", (F.col("weight") * 2).alias("weight"), "price"), 100_000)


@query("win_last_series30", "select ticker, array_to_string(list(round(close, 2) order by dt), ',') series from (select * from fx_prices qualify row_number() over (partition by ticker order by dt desc) <= 30) group by 1")
def _(spark, d):
    return X.last_array(fx.prices(spark, d)).select("ticker", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


# ---------------------------------------------------------------- tops


@query("top_worst3", "select scenario, pct_loss from (select s scenario, sum(weight*v) pct_loss from fx_eur cross join (values ('a', -0.1::double), ('b', -0.3::double), ('c', 0.2::double), ('d', -0.05::double)) t(s, v) where asset_class='equity' group by 1) order by round(pct_loss, 9), 1 limit 3", d="pct_loss")
def _(spark, d):
    shocks = [("a", -0.1, 0.0, 0.0), ("b", -0.3, 0.0, 0.0), ("c", 0.2, 0.0, 0.0), ("d", -0.05, 0.0, 0.0)]
    rows = T.hypothetical(fx.holdings_eur(spark, d), 1.0, shocks).filter("scenario <> 'Single Pos Gap -40%'")
    return T.worst(rows)


_SUG = "select ticker, weight, 0.04::double target, 0.04-weight delta, case when abs(0.04-weight) < 0.002 then 3 else 2 end t0 from " + _W + " w"


@query("top_suggestions", f"select ticker, delta, tier, row_number() over (order by tier, round(abs(delta),9) desc, ticker) place from (select ticker, delta, case when abs(delta) < 0.02 then 3 when false or abs(delta) < 0.05 then 2 else 1 end tier from ({_SUG}))", d="delta", i="tier place")
def _(spark, d):
    w = _weights(spark, d)
    return A.rebalance(w, w.withColumn("weight", F.lit(0.04)), F.lit(False)).select("ticker", "delta", "tier", "place")


@query("top_candidates", f"select ticker, weight*2-0.05 gain, row_number() over (order by round(weight*2-0.05, 9) desc, ticker) place from {_W} w", d="gain", i="place")
def _(spark, d):
    from tideline.operators.report import ranked

    return ranked(_weights(spark, d).select("ticker", (F.col("weight") * 2 - 0.05).alias("gain")), F.round("gain", 9).desc(), F.col("ticker"))


@query("top_drivers", f"select ticker, factor, pct_of_total, place from (select *, row_number() over (partition by ticker order by round(abs(pct_of_total),9) desc, factor) place from ({_attr(63)}) where abs(pct_of_total) >= 0.05) where place <= 3", d="pct_of_total", i="place", digits=5)
def _(spark, d):
    return R.drivers(_attribution(spark, d, 63)).select("ticker", "factor", "pct_of_total", "place")


@query("top_k_alpha", f"select w, ticker, place from ({_TOP}) where place <= 5", i="w place")
def _(spark, d):
    return _top(spark, d).filter("place <= 5").select("w", "ticker", "place")


# ---------------------------------------------------------------- scalar functions

_PPF = "(case when p < 0.5 then -1 else 1 end) * (t - (2.515517+0.802853*t+0.010328*t*t)/(1+1.432788*t+0.189269*t*t+0.001308*t*t*t))"


_ERFC = "0.0"
for _a in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
    _ERFC = f"({_ERFC})*t + ({_a})"


@query("fn_norm_cdf", f"select event_id, 0.5*case when x >= 0 then y else 2 - y end p from (select *, t*exp(-x*x + {_ERFC}) y from (select event_id, x, 1/(1+0.5*abs(x)) t from (select event_id, -value/50/sqrt(2.0::double) x from events)))", d="p", i="event_id")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", S.norm_cdf(F.col("value") / 50).alias("p"))


@query("fn_norm_ppf", f"select id, {_PPF} z from (select p_partkey id, p_size/51.0 p, sqrt(-2*ln(least(p_size/51.0, 1-p_size/51.0))) t from part)", d="z", i="id", digits=5)
def _(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.norm_ppf(F.col("p_size") / 51.0).alias("z"))


fx.SQL["fx_irs"] = "select ticker, avg(ret)/stddev_samp(ret) ir, count(*) n, skewness(ret) s, kurtosis(ret)+3 k from fx_returns group by 1 having count(*) > 3"


def irs(spark, d):
    r = fx.returns(spark, d).groupBy("ticker").agg((F.avg("ret") / F.stddev_samp("ret")).alias("ir"), F.count("*").alias("n"), M.skew("ret").alias("s"), (M.kurtosis("ret") + 3).alias("k"))
    return r.filter("n > 3")


@query("fn_psr", "select ticker, case when 1-s*ir+(k-1)/4*ir*ir > 0 then ir*sqrt(n-1)/sqrt(1-s*ir+(k-1)/4*ir*ir) end z from fx_irs", d="z")
def _(spark, d):
    return irs(spark, d).select("ticker", S.psr_z("ir", "n", "s", "k").alias("z"))


_G = "0.5772156649015329"


def _ppf_of(p):
    t = f"sqrt(-2*ln(1-({p})))"
    return f"({t} - (2.515517+0.802853*{t}+0.010328*{t}*{t})/(1+1.432788*{t}+0.189269*{t}*{t}+0.001308*{t}*{t}*{t}))"


@query("fn_emax_ir", f"select ticker, ((1-{_G})*{_ppf_of('1-1/500.0::double')} + {_G}*{_ppf_of('1-1/(500.0::double*2.718281828459045::double)')})/sqrt(n) emax from fx_irs", d="emax")
def _(spark, d):
    return irs(spark, d).select("ticker", S.expected_max_ir(F.lit(500.0), "n").alias("emax"))


@query("fn_cf_z", f"select ticker, {_CF} z from (select ticker, s, k-3 k from fx_irs)", d="z")
def _(spark, d):
    return irs(spark, d).select("ticker", M.cornish_fisher(M.PPF[0.95], F.col("s"), F.col("k") - 3).alias("z"))


@query("fn_t_stat", "select ticker, avg(ret)/(stddev_samp(ret)/sqrt(count(*))) t from fx_returns group by 1", d="t")
def _(spark, d):
    r = fx.returns(spark, d).groupBy("ticker").agg(F.avg("ret").alias("m"), (F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("se"))
    return r.select("ticker", S.t_stat("m", "se").alias("t"))


@query("fn_bond_symbol", "select p_partkey id, case p_size % 3 when 0 then (p_size % 5) + (p_size % 4 + 1)/8.0 when 1 then (p_size % 5) + 0.5 end coupon, case when p_size % 3 < 2 then '06/30/27' end maturity from part", d="coupon", i="id")
def _(spark, d):
    s = F.expr("case p_size % 3 when 0 then concat('T ', p_size % 5, ' ', p_size % 4 + 1, '/8 06/30/27') when 1 then concat('T ', p_size % 5, '.5 06/30/27') else p_brand end")
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.bond_coupon(s).alias("coupon"), S.bond_maturity(s).alias("maturity"))


@query("fn_t212_ticker", "select p_partkey id, replace(p_brand, '#', '') ticker from part", i="id")
def _(spark, d):
    code = F.expr("concat(replace(p_brand, '#', ''), case when p_size % 3 = 0 then '_US_EQ' when p_size % 3 = 1 then '_eq' else '_GB_ETF' end)")
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.broker_ticker(code).alias("ticker"))


@query("fn_instrument_map", "select p_partkey id, case p_size % 3 when 0 then 'MAGS' when 1 then 'GLD' else p_brand end ticker from part", i="id")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for kv in P.INSTRUMENTS.items() for x in kv])
    name = F.expr("case p_size % 3 when 0 then 'MAG-7' when 1 then 'GOLD' else p_brand end")
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(names[name], name).alias("ticker"))


@query("fn_dot_dash", "select doc_id id, replace(source || '.' || lang, '.', '-') name from documents", i="id")
def _(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.dot_dash(F.concat("source", F.lit("."), "lang")).alias("name"))


@query("fn_search", "select p_partkey id, p_name name, p_type from part where lower(p_name) like '%ring%' or lower(p_type) like '%ring%'", i="id")
def _(spark, d):
    return fx.table(spark, d, "part").filter(S.matches("RING", "p_name", "p_type")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_type")


@query("fn_promo_note", "select ticker, notes, starts_with(notes, 'FF5 signal=') promoted, case when notes <> 'manual' then cast(date '1998-12-31' - cast(regexp_extract(notes, '\\[(.*)\\]', 1) as date) as bigint) end age from fx_watchlist", i="age")
def _(spark, d):
    return fx.watchlist(spark, d).select("ticker", "notes", S.is_promoted("notes").alias("promoted"), F.datediff(F.lit("1998-12-31").cast("date"), S.note_date("notes")).alias("age"))


@query("fn_fmt_pct", "select event_id id, printf('%+.1f%%', round(value)/8*100) s from events", i="id")
def _(spark, d):
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), S.fmt_pct(F.round("value") / 8).alias("s"))


@query("fn_fmt_eur", "select p_partkey id, '€' || format('{:,}', cast(p_size*1000+p_partkey as bigint)) s from part", i="id")
def _(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.fmt_eur((F.col("p_size") * 1000 + F.col("p_partkey")).cast("double")).alias("s"))


@query("fn_driver_text", f"select ticker, string_agg(upper(factor) || ' ' || printf('%+.0f%%', round(pct_of_total*100, 4)), ' · ' order by place) text from (select *, row_number() over (partition by ticker order by round(abs(pct_of_total),9) desc, factor) place from ({_attr(63)}) where abs(pct_of_total) >= 0.05) where place <= 3 group by 1")
def _(spark, d):
    return R.driver_text(R.drivers(_attribution(spark, d, 63)))


@query("fn_reason_text", f"select ticker, case when t > 1.5 then 'BUY' when t < -1.5 then 'SELL' else 'HOLD' end || ': t ' || printf('%.2f', t) || case when abs(t) >= 2 then ' (strong)' else '' end reason from (select ticker, avg(ret)/(stddev_samp(ret)/sqrt(count(*)))*40 t from fx_returns group by 1)")
def _(spark, d):
    t = fx.returns(spark, d).groupBy("ticker").agg((F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("*"))) * 40).alias("t"))
    return t.select("ticker", F.concat(P.signal(F.col("t")), F.lit(": t "), S.fmt_float("t"), F.when(F.abs("t") >= 2, " (strong)").otherwise("")).alias("reason"))


@query("fn_json", "select event_id id, cast(json_extract(props, '$.k') as bigint) k from events", i="id k")
def _(spark, d):
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("fn_ms_ts", "select event_id id, date_trunc('millisecond', ts) ts from events", i="id")
def _(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), S.millis(ms).cast("timestamp_ntz").alias("ts"))


@query("fn_slice_date", "select event_id id, strftime(ts, '%Y-%m-%d') s from events", i="id")
def _(spark, d):
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), S.iso_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("s"))


@query("fn_trading_cost", "select sum(5.0 + market_value_eur*5/1e4 + market_value_eur*0.1*0.015*sqrt(market_value_eur/500000)) cost from fx_eur where market_value_eur > 0", d="cost", digits=2)
def _(spark, d):
    return fx.holdings_eur(spark, d).agg(F.sum(S.trading_cost("market_value_eur", F.lit(500000.0))).alias("cost"))


@query("fn_cgt", "select ticker, 0.33*greatest(sum(market_value_eur-cost_basis_eur)-1270, 0) tax from fx_eur group by 1", d="tax", digits=2)
def _(spark, d):
    return fx.holdings_eur(spark, d).groupBy("ticker").agg(S.capital_gains_tax(F.sum(F.col("market_value_eur") - F.col("cost_basis_eur"))).alias("tax"))


@query("fn_margin", "select path, bool_or((nav-0.7)/nav < 0.25) called from fx_nav group by 1", i="path")
def _(spark, d):
    from tideline.operators.montecarlo import nav_paths

    return nav_paths(paths(spark, d)).groupBy("path").agg(F.collect_list("nav").alias("navs")).select("path", S.margin_call("navs", F.lit(0.7)).alias("called"))


@query("fn_adaptive_bounds", "select w, n, greatest(0.001, 0.5/n) low, greatest(least(0.4, 5.0/n), 2*greatest(0.001, 0.5/n)) high from fx_wf", d="low high", i="w n")
def _(spark, d):
    n = _ic_rows(spark, d).groupBy("w").agg(F.count("*").alias("n"))
    low, high = S.weight_bounds("n")
    return n.select("w", "n", low.alias("low"), high.alias("high"))


@query("fn_annualise", "select ticker, avg(ret)*252 r, stddev_samp(ret)*sqrt(252) v from fx_returns group by 1", d="r v")
def _(spark, d):
    return fx.returns(spark, d).groupBy("ticker").agg((F.avg("ret") * 252).alias("r"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("v"))
