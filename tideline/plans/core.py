"""Queries of scans, projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import joins as J
from tideline.operators import portfolio as P
from tideline.operators import series as X
from tideline.plans import fixtures as fx
from tideline.plans.registry import query
from tideline.sources import market as M

AS_OF = "(select max(dt) from fx_prices)"


def _as_of(spark: SparkSession, d: str):
    return F.lit(fx.prices(spark, d).agg(F.max("dt")).first()[0])


@query("src_ohlcv", f"select * from fx_prices where dt >= {AS_OF} - 365 and dt <= {AS_OF}", d="close volume")
def _(spark, d):
    return M.history(fx.prices(spark, d))


@query("src_last_price", "select ticker, coalesce(q, c) price from (select ticker, arg_max(close, dt) c from fx_prices group by 1) left join (select p_brand t, max(p_retailprice) q from part where p_size > 48 group by 1) on ticker = t", d="price")
def _(spark, d):
    quotes = fx.table(spark, d, "part").filter("p_size > 48").groupBy(F.col("p_brand").alias("ticker")).agg(F.max("p_retailprice").alias("quote"))
    bars = fx.prices(spark, d)
    return M.last_price(bars, quotes.join(bars.select("ticker").distinct(), "ticker", "left_semi"))


@query("src_batch_close", "select p_brand ticker, cast(l_shipdate as date) dt, 100+10*ln(sum(l_extendedprice)/sum(l_quantity)) as close from lineitem join part on l_partkey=p_partkey group by 1, 2", d="close")
def _(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", "p_brand")
    names = sorted(r["p_brand"] for r in part.select("p_brand").distinct().collect())  # a column per ticker of the batch
    lines = fx.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    wide = lines.groupBy(F.to_date("l_shipdate").alias("dt")).pivot("p_brand", names).agg(100 + 10 * F.log(F.sum("l_extendedprice") / F.sum("l_quantity")))
    return M.wide_closes(wide, names)


@query("src_fallback", "select ticker, dt, close from fx_prices where ticker < 'Brand#30' union all select ticker, dt, close + 1 from fx_prices where ticker not in (select ticker from fx_prices where ticker < 'Brand#30')", d="close")
def _(spark, d):
    p = fx.prices(spark, d).select("ticker", "dt", "close")
    return M.with_fallback(p.filter("ticker < 'Brand#30'"), p.withColumn("close", F.col("close") + 1))


def _bodies(spark, d):
    rows = fx.prices(spark, d).select("ticker", F.struct((F.unix_date("dt").cast("long") * 86400000).alias("t"), F.col("close").alias("c")).alias("r"))
    return rows.groupBy("ticker").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("body"))


@query("src_rest_daily", "select ticker, dt, close from fx_prices", d="close")
def _(spark, d):
    return M.rest_daily(_bodies(spark, d))


def _save_pages(folder: str):
    def run(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(f"{folder}/{r['ticker']}-{r['page']}.json", "w", encoding="utf-8") as f:
                f.write(r["body"])

    return run


@query("src_get_retry", "select ticker, dt, close from fx_prices", d="close")
def _(spark, d):
    from tideline.plans.scratch import folder
    from tideline.sources.services import read_pages

    base = folder(spark)
    here = base.removeprefix("file://")
    w = W.partitionBy("ticker").orderBy("dt")
    rows = fx.prices(spark, d).withColumn("page", F.floor((F.row_number().over(w) - 1) / 400).cast("int"))
    result = F.struct((F.unix_date("dt").cast("long") * 86400000).alias("t"), F.col("close").alias("c"))
    bodies = rows.groupBy("ticker", "page").agg(F.collect_list(result).alias("results"))
    last = F.max("page").over(W.partitionBy("ticker"))
    bodies = bodies.withColumn("next", F.col("page") < last).select("ticker", "page", F.to_json(F.struct("results", "next")).alias("body"))
    bodies.foreachPartition(_save_pages(f"{here}/service"))
    tickers = [r["ticker"] for r in bodies.select("ticker").distinct().collect()]  # what the service is asked for
    got = read_pages(spark, f"file://{here}/service/{{ticker}}-{{page}}.json", tickers, pause=0.01, drill=2, cache=f"{here}/cache")
    return M.rest_daily(got.select("ticker", "body"))


@query("src_rest_snapshot", "select c_mktsegment || cast(c_custkey as varchar) ticker, case when c_acctbal > 0 then c_acctbal else 5.0 end price from customer where c_acctbal > 0 or c_nationkey > 5", d="price")
def _(spark, d):
    name = F.concat("c_mktsegment", F.col("c_custkey").cast("string"))
    day = F.struct(F.greatest("c_acctbal", F.lit(0.0)).alias("c")).alias("day")
    trade = F.struct(F.when(F.col("c_nationkey") > 5, 5.0).otherwise(0.0).alias("p")).alias("lastTrade")
    rows = fx.table(spark, d, "customer").select(F.struct(name.alias("ticker"), day, trade).alias("r"), "c_nationkey")
    return M.rest_snapshot(rows.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list("r").alias("tickers"))).alias("body")))


_PAIRS = "case event_type when 'click' then 'USDEUR' when 'view' then 'GBPEUR' else event_type end"


@query("src_fx", f"select pair, coalesce(1/c, dflt) rate from (values ('USDEUR',0.92::double),('GBPEUR',1.17::double),('AUDEUR',0.59::double)) t(pair, dflt) left join (select {_PAIRS} p, arg_max(abs(value)+1, ts) c from events group by 1) on p = pair", d="rate")
def _(spark, d):
    return M.fx_rates(fx.table(spark, d, "events").select(F.expr(_PAIRS).alias("ticker"), F.col("ts").alias("dt"), F.expr("abs(value) + 1").alias("close")))


@query("src_ff5", "select * from fx_factors", d="mkt_rf smb hml rmw cma rf", digits=9)
def _(spark, d):
    f = fx.factors(spark, d)
    return M.percent_factors(f.select("dt", *[(F.col(c) * 100).alias(c) for c in f.columns if c != "dt"]))


@query("src_kf", "select dt, cma mom from fx_factors", d="mom", digits=9)
def _(spark, d):
    return M.percent_factors(fx.factors(spark, d).select("dt", (F.col("cma") * 100).alias("Mom   ")), {"Mom": "mom"}, "1900-01-01")


_IB = "case when p_size % 9 = 0 then concat('T ', p_size % 5, ' ', p_size % 4 + 1, '/8 06/30/', 20 + p_size % 9) when p_size % 9 = 1 then concat('T ', p_size % 5, '.5 12/31/', 20 + p_size % 9) else p_brand end"
_CAT = "case p_size % 4 when 0 then 'STK' when 1 then 'ETF' when 2 then 'FUND' else 'OPT' end"


@query(
    "src_ibkr",
    f"""select symbol ticker, case when coupon is not null then 'bond' else 'equity' end asset_class, coupon,
    case when coupon is not null then right(symbol, 8) end maturity, quantity,
    coalesce(pv, case when coupon is not null then mark/100*quantity else mark*quantity end) * case when cur = 'USD' then 0.92 else 1.0 end market_value_eur
    from (select {_IB} symbol, {_CAT} cat, cast(p_size as double) quantity, p_retailprice mark, case when p_size % 3 = 0 then p_retailprice * 2 end pv, case when p_size % 2 = 0 then 'USD' else 'CHF' end cur,
    case when p_size % 9 = 0 then (p_size % 5) + (p_size % 4 + 1)/8.0 when p_size % 9 = 1 then (p_size % 5) + 0.5 end coupon from part) where cat <> 'OPT'""",
    d="coupon quantity market_value_eur",
)
def _(spark, d):
    rows = fx.table(spark, d, "part").select(F.expr(_IB).alias("symbol"), F.expr(_CAT).alias("category"), F.expr("cast(p_size as double) quantity"), F.col("p_retailprice").alias("mark"), F.expr("case when p_size % 3 = 0 then p_retailprice * 2 end position_value"), F.expr("case when p_size % 2 = 0 then 'USD' else 'CHF' end currency"))
    return M.ibkr_positions(rows, fx.fx(spark))


@query("src_t212", "select replace(p_brand, '#', '') ticker, cast(p_size as double) quantity, p_retailprice * p_size market_value_eur, p_size / 2.0 pnl_eur, 'EUR' currency from part", d="quantity market_value_eur pnl_eur")
def _(spark, d):
    r = F.struct(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_US_EQ")).alias("ticker"), F.col("p_size").cast("double").alias("quantity"), F.col("p_retailprice").alias("currentPrice"), (F.col("p_size") / 2).alias("ppl"))
    return M.t212_positions(fx.table(spark, d, "part").groupBy("p_type").agg(F.to_json(F.collect_list(r)).alias("body")))


@query("src_etoro_api", "select case p_size % 3 when 0 then 'MAGS' when 1 then 'GLD' else p_brand end ticker, p_retailprice * 0.92 market_value_eur, p_size * 0.92 pnl_eur from part", d="market_value_eur pnl_eur")
def _(spark, d):
    r = F.struct(F.expr("case p_size % 3 when 0 then 'MAG-7' when 1 then 'GOLD' else p_brand end").alias("InstrumentName"), F.col("p_retailprice").alias("Amount"), F.col("p_size").cast("double").alias("NetProfit"))
    body = F.to_json(F.struct(F.struct(F.collect_list(r).alias("Positions")).alias("PublicPortfolio")))
    return M.etoro_positions(fx.table(spark, d, "part").groupBy("p_type").agg(body.alias("body")), 0.92)


@query("src_etoro_csv", "select h.ticker, h.platform, coalesce(p.close*f.rate_eur*h.quantity, 0) market_value_eur from fx_holdings h left join (select ticker, arg_max(close, dt) as close from fx_prices where ticker < 'Brand#40' group by 1) p using(ticker) join fx_fx f using(currency)", d="market_value_eur", digits=3)
def _(spark, d):
    last = M.last_price(fx.prices(spark, d).filter("ticker < 'Brand#40'"))
    return M.priced_csv(fx.holdings(spark, d), last, fx.fx(spark)).select("ticker", "platform", "market_value_eur")


@query("src_html_table", """select page_id, cast(place - 1 as bigint) place, name, replace(name, '.', '-') ticker from (select page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) as name, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), 1) as place from pages)""", i="place")
def _(spark, d):
    return M.table_rows(fx.table(spark, d, "pages"))


@query("src_universe_cached", f"select distinct p_brand ticker from part where p_size % 15 <= 7")
def _(spark, d):
    as_of = F.lit("1998-12-31").cast("date")
    cache = fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker"), F.date_sub(as_of, F.col("p_size") % 15).alias("written"))
    return M.fresh(cache, as_of, 7).select("ticker").distinct()


@query("src_universe_prices", "with w as (select ticker from fx_watchlist), u as (select ticker, 'watchlist' origin, 0 place from w union all select * from (select p_brand ticker, 'member' origin, cast(min(p_partkey) as bigint) place from part where p_brand not in (select ticker from w) group by 1 order by 3 limit 4)) select u.ticker, u.origin, u.place, p.dt, p.close from u join fx_prices p using(ticker)", d="close", i="place")
def _(spark, d):
    members = fx.table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_partkey").alias("place"))
    return M.universe(fx.watchlist(spark, d).select("ticker"), members, 4).join(M.closes(fx.prices(spark, d)), "ticker")


@query("src_watchlist", "select * from fx_watchlist", d="weight")
def _(spark, d):
    return fx.watchlist(spark, d)


@query("src_sql_hist", "select ticker, dt, close, cast(n - r + 1 as bigint) place from (select *, row_number() over (partition by ticker order by dt desc) r, least(count(*) over (partition by ticker), 30) n from fx_prices) where r <= 30", d="close", i="place")
def _(spark, d):
    return M.last_rows(fx.prices(spark, d).select("ticker", "dt", "close"), 30)


@query("sink_prices", "select ticker, dt, case when dt >= date '1998-01-01' then close * 2 else close end as close from fx_prices", d="close")
def _(spark, d):
    old = fx.prices(spark, d).select("ticker", "dt", "close")
    return J.upsert(old, old.filter("dt >= date'1998-01-01'").withColumn("close", F.col("close") * 2), ["ticker", "dt"])


@query("sink_snapshot_upsert", "select event_type ticker, arg_max(value, ts) price, max(ts) ts from events group by 1", d="price")
def _(spark, d):
    from tideline.streaming.bars import latest_prices

    ticks = fx.table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("value").alias("price"), "ts")
    old = latest_prices(ticks.filter("ts < timestamp_ntz'1998-01-01'"))
    return J.upsert(old, latest_prices(ticks), ["ticker"])


def _twice(spark, d, name, df):
    from tideline.plans.scratch import folder

    path = f"{folder(spark)}/{name}"
    M.append(df.filter("id % 2 = 0"), path)
    M.append(df.filter("id % 2 = 1"), path)
    return spark.read.schema(df.schema).parquet(path)


@query("sink_news", "select doc_id id, source, lang from documents", i="id")
def _(spark, d):
    return _twice(spark, d, "news", fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang"))


@query("sink_suggestion", "select id, dt, ticker, recommendation from fx_suggestions", i="id")
def _(spark, d):
    return _twice(spark, d, "suggestions", fx.suggestions(spark, d).select("id", "dt", "ticker", "recommendation"))


@query("sink_backtest", "select o_custkey id, count(*) trades, sum(o_totalprice) total from orders group by 1", d="total", i="id trades", digits=2)
def _(spark, d):
    return _twice(spark, d, "backtests", fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("trades"), F.sum("o_totalprice").alias("total")))


@query("sink_dq", "select doc_id id, 'short text' warning from documents where n_chars < 200", i="id")
def _(spark, d):
    return _twice(spark, d, "warnings", fx.table(spark, d, "documents").filter("n_chars < 200").select(F.col("doc_id").alias("id"), F.lit("short text").alias("warning")))


_RUNS = "select user_id run_id, ts as at, case event_type when 'click' then 'success' when 'view' then 'running' else 'failed' end status, event_id from events"


def runs(spark, d):
    status = F.expr("case event_type when 'click' then 'success' when 'view' then 'running' else 'failed' end")
    return fx.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), status.alias("status"), "value")


@query("sink_run_lifecycle", f"select run_id, min(\"at\") started, arg_max(status, \"at\") status, max(\"at\") changed from ({_RUNS}) group by 1", i="run_id")
def _(spark, d):
    return M.latest_runs(runs(spark, d))


@query("sink_eval_update", "select id, dt, ticker, recommendation, case when id % 3 = 0 then id / 100.0 end actual_return, case when id % 3 = 0 then cast(id % 2 as bigint) end accurate from fx_suggestions", d="actual_return", i="id accurate")
def _(spark, d):
    s = fx.suggestions(spark, d)
    results = s.filter("id % 3 = 0").select("id", (F.col("id") / 100).alias("actual_return"), (F.col("id") % 2).alias("accurate"))
    return M.evaluated(s, results)


@query("sink_snapshot_json", f"select distinct dt from fx_prices where {AS_OF} - dt <= 7")
def _(spark, d):
    return M.pruned(fx.prices(spark, d).select("dt").distinct(), _as_of(spark, d))


@query("src_snapshot", f"select dt, {AS_OF} - dt age, sum(volume) volume from fx_prices where {AS_OF} - dt between 7 and 9 group by 1 order by 2 limit 1", d="volume", i="age")
def _(spark, d):
    snaps = fx.prices(spark, d).groupBy("dt").agg(F.sum("volume").alias("volume"))
    return M.week_ago(snaps, str(fx.prices(spark, d).agg(F.max("dt")).first()[0])).select("dt", "age", "volume")


@query("sink_watchlist", "select ticker, notes from fx_watchlist where notes = 'manual' union all select p_brand, concat('FF5 signal=BUY t=2.00 IR=', '1.00', ' [1998-09-01]') from (select distinct p_brand from part) where p_brand not in (select ticker from fx_watchlist)")
def _(spark, d):
    w = fx.watchlist(spark, d)
    new = fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct().join(w, "ticker", "left_anti")
    note = S.promotion_note(F.lit("BUY"), F.lit(2.0), F.lit(1.0), F.lit("1998-09-01").cast("date"))
    return w.filter("notes = 'manual'").select("ticker", "notes").unionByName(new.withColumn("notes", note))


# ---------------------------------------------------------------- projections, filters, classes


@query("proj_returns", "select * from fx_returns", d="ret", digits=9)
def _(spark, d):
    return fx.returns(spark, d)


@query("proj_excess", "select ticker, dt, y from fx_aligned", d="y", digits=9)
def _(spark, d):
    return fx.aligned(spark, d).select("ticker", "dt", "y")


_STATUS = "select ticker, least(count(*), 1400) as days, case when count(*) = 0 then 'unavailable' when count(*) < 21 then 'excluded' when count(*) < 1400 then 'reduced' else 'ok' end status, case when count(*) >= 21 and count(*) < 1400 then concat('[', count(*), 'd window]') else '' end flag from fx_prices group by 1"


@query("flt_status", f"select r.ticker, r.dt, r.ret from fx_returns r where ticker in (select ticker from ({_STATUS}) where status in ('ok','reduced') and days > 30)", d="ret", digits=9)
def _(spark, d):
    status = P.classify_series(fx.prices(spark, d), 1400).filter("status in ('ok', 'reduced') and days > 30")
    return fx.returns(spark, d).join(status, "ticker", "left_semi")


@query("flt_asset_class", "select ticker, coalesce(asset_class, 'equity') asset_class from fx_watchlist where coalesce(asset_class, 'equity') = 'equity'")
def _(spark, d):
    return P.equity_only(fx.watchlist(spark, d)).select("ticker", F.coalesce("asset_class", F.lit("equity")).alias("asset_class"))


@query("flt_dropna", "select ticker, ts, open, high, low, case when low > -50 then close end as close from fx_bars_h where low > -50", d="open high low close")
def _(spark, d):
    bars = fx.bars_h(spark, d).withColumn("close", F.when(F.col("low") > -50, F.col("close")))
    return bars.na.drop(subset=["open", "high", "low", "close"]).select("ticker", "ts", "open", "high", "low", "close")


@query("cls_series", _STATUS, i="days")
def _(spark, d):
    return P.classify_series(fx.prices(spark, d), 1400)


_T = "select ticker, avg(ret)/(stddev_samp(ret)/sqrt(count(*)))*40 t from fx_returns group by 1"


def _t(spark, d):
    return fx.returns(spark, d).groupBy("ticker").agg((F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("*"))) * 40).alias("t"))


@query("cls_signal", f"select ticker, case when t > 1.5 then 'BUY' when t < -1.5 then 'SELL' else 'HOLD' end signal from ({_T})")
def _(spark, d):
    return _t(spark, d).select("ticker", P.signal(F.col("t")).alias("signal"))


@query("cls_stars", f"select ticker, case when abs(t) >= 3 then '★★★' when abs(t) >= 2 then '★★' when abs(t) >= 1.5 then '★' else '' end stars from ({_T})")
def _(spark, d):
    return _t(spark, d).select("ticker", P.stars(F.col("t")).alias("stars"))


@query("cls_style", "select ticker, factor, case when s > hi then 'high' when s < lo then 'low' else 'neutral' end style from (select ticker, unnest(['smb','hml']) factor, unnest([regr_slope(y, smb), regr_slope(y, hml)]) s from fx_aligned group by 1) join (values ('smb', -0.01::double, 0.01::double), ('hml', -0.02::double, 0.02::double)) b(f, lo, hi) on f = factor")
def _(spark, d):
    from tideline.operators.factors import style_labels

    slopes = fx.aligned(spark, d).groupBy("ticker").agg(F.regr_slope("y", "smb").alias("smb"), F.regr_slope("y", "hml").alias("hml")).unpivot(["ticker"], ["smb", "hml"], "factor", "beta")
    bounds = spark.createDataFrame([("smb", -0.01, 0.01, "low", "high"), ("hml", -0.02, 0.02, "low", "high")], "factor string, lo double, hi double, below string, above string")
    return style_labels(slopes, bounds).select("ticker", "factor", "style")


@query("cls_tier", "select ticker, platform, cast(case when abs(delta) < 0.02 then 3 when cgt or abs(delta) < 0.05 then 2 else 1 end as bigint) tier from (select ticker, platform, weight * 3 - 0.04 delta, cost_basis_eur < market_value_eur cgt from fx_eur)", i="tier")
def _(spark, d):
    h = fx.holdings_eur(spark, d)
    return h.select("ticker", "platform", P.tier(F.col("weight") * 3 - 0.04, F.col("cost_basis_eur") < F.col("market_value_eur")).alias("tier"))


@query("cls_verdict", "select ticker, case when weight > 0.006 and weight*2 - 0.025 > 0 then 'add' when weight > 0.006 then 'neutral' else 'skip' end verdict from (select ticker, sum(weight) weight from fx_eur group by 1)")
def _(spark, d):
    from tideline.operators.allocation import candidate_verdict

    w = P.by_ticker(fx.holdings_eur(spark, d))
    return w.select("ticker", candidate_verdict(F.col("weight"), F.col("weight") * 2 - 0.025).alias("verdict"))


@query("map_remap", "select case p_brand when 'Brand#11' then 'NBIS' else p_brand end ticker, case when p_brand = 'Brand#11' and p_size % 2 = 0 then 'NBIS' when p_size % 2 = 0 then p_brand else p_name end description from part")
def _(spark, d):
    rows = fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("description"))
    return P.remap(rows, {"Brand#11": "NBIS"})


@query("proj_fx", "select ticker, platform, market_value_eur, cost_basis_eur from fx_eur", d="market_value_eur cost_basis_eur", digits=3)
def _(spark, d):
    return P.to_eur(fx.holdings(spark, d), fx.fx(spark)).select("ticker", "platform", "market_value_eur", "cost_basis_eur")


@query("proj_weight", "select ticker, platform, weight from fx_eur", d="weight", digits=9)
def _(spark, d):
    return fx.holdings_eur(spark, d).select("ticker", "platform", "weight")


@query("proj_pnl_pct", "select ticker, platform, market_value_eur - cost_basis_eur pnl_eur, coalesce((market_value_eur - cost_basis_eur)/nullif(cost_basis_eur, 0), 0) pnl_pct from fx_eur", d="pnl_eur pnl_pct", digits=4)
def _(spark, d):
    return P.pnl_pct(fx.holdings_eur(spark, d)).select("ticker", "platform", "pnl_eur", "pnl_pct")


@query("dq_gap", "select ticker, count(*) as rows, (max(dt)-min(dt))*5/7.0 expected, (max(dt)-min(dt))*5/7.0 - count(*) missing from fx_prices group by 1 having (max(dt)-min(dt))*5/7.0 - count(*) > 10", d="expected missing", i="rows")
def _(spark, d):
    return P.gaps(fx.prices(spark, d))


@query("dq_spike", "select * from fx_returns where abs(ret) > 0.05", d="ret", digits=9)
def _(spark, d):
    return P.spikes(fx.returns(spark, d), 0.05)


@query("dq_stale", "select ticker, last_dt, max(last_dt) over () as_of, cast(max(last_dt) over () - last_dt as bigint) age from (select ticker, max(dt) last_dt from fx_prices group by 1) qualify max(last_dt) over () - last_dt > 1", i="age")
def _(spark, d):
    return P.stale(fx.prices(spark, d), days=1)


@query("dq_news", "select source, count(*) seen, count(*) filter (n_chars >= 300 or lang <> 'en') kept from documents group by 1", i="seen kept")
def _(spark, d):
    from tideline.operators.report import news_quality

    rows = fx.table(spark, d, "documents").select("source", F.when(F.col("n_chars") >= 300, F.col("lang")).alias("title"), F.when(F.col("lang") != "en", F.col("lang")).alias("description"))
    return news_quality(rows)


@query("flt_market_hours", "select event_id, ts from events where dayofweek(ts) between 1 and 5 and hour(ts)*60+minute(ts) between 870 and 1260", i="event_id")
def _(spark, d):
    return P.market_hours(fx.table(spark, d, "events").select("event_id", "ts"))


@query("flt_dedup_alert", "select id, key, fired_at from (select event_id id, event_type || cast(user_id as varchar) key, ts fired_at from events where value > 0) a where not exists (select 1 from events e where value <= 0 and e.event_type || cast(e.user_id as varchar) = a.key and e.ts <= a.fired_at and e.ts > a.fired_at - interval 24 hours)", i="id")
def _(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("ts").alias("fired_at"), "value")
    return P.new_alerts(e.filter("value > 0").drop("value"), e.filter("value <= 0"))


# ---------------------------------------------------------------- joins


@query("join_factor_inner", "select ticker, dt, ret, mkt_rf, rf from fx_aligned", d="ret mkt_rf rf", digits=9)
def _(spark, d):
    return fx.aligned(spark, d).select("ticker", "dt", "ret", "mkt_rf", "rf")


@query("join_align_inner", "select ticker, dt, ret from fx_returns_region where dt in (select dt from fx_returns_region group by 1 having count(*) = 5)", d="ret", digits=9)
def _(spark, d):
    return J.align_inner(fx.returns_region(spark, d), 5)


_W = "(select ticker, sum(weight) weight from fx_eur group by 1)"


@query("join_align_outer", f"select dt, sum(weight*ret) ret from fx_returns join {_W} using(ticker) group by 1", d="ret")
def _(spark, d):
    return J.weighted_sum(fx.returns(spark, d), P.by_ticker(fx.holdings_eur(spark, d)))


@query("join_add_fill0", f"select dt, sum(weight*y) ret from fx_aligned join {_W} using(ticker) group by 1", d="ret")
def _(spark, d):
    return J.weighted_sum(fx.aligned(spark, d).select("ticker", "dt", F.col("y").alias("ret")), P.by_ticker(fx.holdings_eur(spark, d)))


@query("join_outer_keepna", "select t.ticker, c.dt, r.ret from (select distinct dt from fx_returns_region) c cross join (select distinct ticker from fx_returns_region) t left join fx_returns_region r on r.ticker=t.ticker and r.dt=c.dt", d="ret", digits=9)
def _(spark, d):
    r = fx.returns_region(spark, d)
    tickers = r.select("ticker").distinct().agg(F.collect_set("ticker").alias("t"))
    spine = r.select("dt").distinct().join(F.broadcast(tickers)).select(F.explode("t").alias("ticker"), "dt")
    return spine.join(r, ["ticker", "dt"], "left").select("ticker", "dt", "ret")


@query("join_pair", "select r.ticker, r.dt, r.ret, b.ret bench from fx_returns_region r join fx_returns_region b on r.dt=b.dt and b.ticker='EUROPE'", d="ret bench", digits=9)
def _(spark, d):
    r = fx.returns_region(spark, d)
    return J.with_benchmark(r, r.filter("ticker = 'EUROPE'")).select("ticker", "dt", "ret", "bench")


@query("join_lookup_left", "select ticker, platform, coalesce(sig, 'HOLD') signal from fx_holdings left join (select r_ticker, arg_max(sig, k) sig from (select p_brand r_ticker, p_partkey k, case when p_size % 2 = 0 then 'BUY' else 'SELL' end sig from part where p_size < 5) group by 1) on r_ticker = ticker")
def _(spark, d):
    signals = fx.table(spark, d, "part").filter("p_size < 5").select(F.col("p_brand").alias("ticker"), F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, "BUY").otherwise("SELL").alias("signal"))
    last = J.last_wins(signals, "ticker", "k")
    return fx.holdings(spark, d).join(last, "ticker", "left").select("ticker", "platform", F.coalesce("signal", F.lit("HOLD")).alias("signal"))


@query("join_anti", "select distinct p_brand ticker from part where p_brand not in (select ticker from fx_watchlist)")
def _(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct().join(fx.watchlist(spark, d), "ticker", "left_anti")


@query("join_semi", "select ticker, platform, quantity from fx_holdings where ticker in (select ticker from fx_watchlist)", d="quantity")
def _(spark, d):
    return fx.holdings(spark, d).join(fx.watchlist(spark, d), "ticker", "left_semi").select("ticker", "platform", "quantity")


@query("join_asof_fwd", "select ticker, eval_dt, arg_min(dt, dt) dt, arg_min(rn, dt) rn from (select distinct ticker from fx_prices) cross join (select unnest([date '1995-06-01', date '1996-06-01', date '1997-06-01', date '2030-01-01']) eval_dt) left join (select ticker, dt, row_number() over (partition by ticker order by dt) rn from fx_prices) p using(ticker) where dt >= eval_dt group by 1, 2", i="rn")
def _(spark, d):
    p = fx.prices(spark, d)
    days = F.array(*[F.lit(x).cast("date") for x in ("1995-06-01", "1996-06-01", "1997-06-01", "2030-01-01")])
    points = p.select("ticker").distinct().withColumn("eval_dt", F.explode(days))
    return J.asof_forward(points, p).filter("dt is not null")


@query("join_asof_back", f"select dt, {AS_OF} - dt age, sum(volume) volume from fx_prices where {AS_OF} - dt between 3 and 30 group by 1 order by 2 limit 1", d="volume", i="age")
def _(spark, d):
    p = fx.prices(spark, d)
    return J.asof_backward(p.groupBy("dt").agg(F.sum("volume").alias("volume")), str(p.agg(F.max("dt")).first()[0]), 3, 30).select("dt", "age", "volume")


_SCEN = "(values ('GFC', date '1995-03-01', date '1995-06-30'), ('COVID', date '1996-02-01', date '1996-03-31'), ('DAY', date '1997-10-20', date '1997-10-20')) s(scenario, start_dt, end_dt)"
SCENARIOS = [("GFC", "1995-03-01", "1995-06-30"), ("COVID", "1996-02-01", "1996-03-31"), ("DAY", "1997-10-20", "1997-10-20")]


@query("join_range", f"select scenario, ticker, count(*) n, min(dt) first_dt, max(dt) last_dt from fx_prices join {_SCEN} on dt between start_dt and end_dt group by 1, 2", i="n")
def _(spark, d):
    from tideline.operators.stress import in_windows, windows_table

    return in_windows(fx.prices(spark, d), windows_table(spark, SCENARIOS)).groupBy("scenario", "ticker").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


_GRID = "select ticker, dt, ret, unnest(range(greatest(0, cast(ceil((r-126)/21.0) as bigint)), (r-1)//21 + 1)) w, r, c from (select *, row_number() over (partition by ticker order by dt) r, count(*) over (partition by ticker) c from fx_returns)"


@query("join_range_window", f"select ticker, w, count(*) n, sum(ret) total from ({_GRID}) where w*21+126 <= c group by 1, 2", d="total", i="w n")
def _(spark, d):
    return X.window_ids(fx.returns(spark, d), 126, 21, 126).groupBy("ticker", "w").agg(F.count("*").alias("n"), F.sum("ret").alias("total"))


@query("join_cross", "select scenario, ticker, platform, weight*shock impact from fx_eur cross join (values ('Rates', -0.04::double), ('USD', -0.08::double), ('Oil', -0.05::double)) s(scenario, shock)", d="impact", digits=9)
def _(spark, d):
    shocks = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("shock")) for n, s in (("Rates", -0.04), ("USD", -0.08), ("Oil", -0.05))])
    return fx.holdings_eur(spark, d).withColumn("s", F.explode(shocks)).select("s.scenario", "ticker", "platform", (F.col("weight") * F.col("s.shock")).alias("impact"))


@query("join_self_pairs", "select a.ticker a, b.ticker b, count(*) n, corr(a.ret, b.ret) corr from fx_returns_region a join fx_returns_region b on a.dt=b.dt and a.ticker < b.ticker group by 1, 2", d="corr", i="n")
def _(spark, d):
    from tideline.operators.moments import pairs

    return pairs(fx.returns_region(spark, d)).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))


# ---------------------------------------------------------------- sorts, limits, sets


@query("top_ir", f"select ticker, t ir, row_number() over (order by round(t, 6) desc nulls last, ticker) place from ({_T})", d="ir", i="place")
def _(spark, d):
    from tideline.operators.report import ranked

    return ranked(_t(spark, d).withColumnRenamed("t", "ir"), F.round("ir", 6).desc_nulls_last(), F.col("ticker"))


@query("top_positions", "select ticker, sum(market_value_eur) mv from fx_eur where asset_class='equity' group by 1 order by round(sum(market_value_eur), 2) desc, 1 limit 10", d="mv", digits=2)
def _(spark, d):
    from tideline.operators.report import top_positions

    return top_positions(fx.holdings_eur(spark, d))


@query("top_bonds", "select ticker, platform, market_value_eur mv, row_number() over (order by round(market_value_eur,2) desc, ticker, platform) place from fx_eur where asset_class='bond'", d="mv", i="place", digits=2)
def _(spark, d):
    from tideline.operators.report import ranked

    bonds = fx.holdings_eur(spark, d).filter("asset_class = 'bond'").select("ticker", "platform", F.col("market_value_eur").alias("mv"))
    return ranked(bonds, F.round("mv", 2).desc(), F.col("ticker"), F.col("platform"))


@query("top_search", "select c_custkey id, c_name name from customer where lower(c_name) like '%00%' and (c_name is not null) order by 1 limit 20", i="id")
def _(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.filter(S.matches(" 00 ", "name")).orderBy("id").limit(20)


@query("top_runs", f"select run_id, \"at\", status from ({_RUNS}) order by \"at\" desc limit 50", i="run_id")
def _(spark, d):
    return runs(spark, d).orderBy(F.desc("at")).limit(50).select("run_id", "at", "status")


@query("sample_seeded", "select ticker, md5(concat(ticker, '1998-09-01')) k from (select distinct p_brand ticker from part) order by 2 limit 7")
def _(spark, d):
    from tideline.operators.allocation import seeded_sample

    return seeded_sample(fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct(), "1998-09-01", 7)


@query("set_union_all", "select ticker, platform, quantity from fx_holdings where platform='IBKR' union all select ticker, platform, quantity from fx_holdings where platform<>'IBKR'", d="quantity")
def _(spark, d):
    h = fx.holdings(spark, d).select("ticker", "platform", "quantity")
    return h.filter("platform = 'IBKR'").unionByName(h.filter("platform = 'T212'")).unionByName(h.filter("platform = 'ETORO'"))


@query("set_union_distinct", "select ticker, row_number() over (order by k, ticker) place from (select ticker, min(k) k from (select ticker, 0 k from fx_watchlist union all select p_brand, 1 from part) group by 1)", i="place")
def _(spark, d):
    return J.union_distinct([fx.watchlist(spark, d), fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker"))], "ticker")


@query("set_except", "select p_brand ticker from part except select ticker from fx_watchlist")
def _(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).subtract(fx.watchlist(spark, d).select("ticker"))


@query("set_intersect", "select p_brand ticker from part where p_size < 10 intersect select ticker from fx_watchlist")
def _(spark, d):
    return fx.table(spark, d, "part").filter("p_size < 10").select(F.col("p_brand").alias("ticker")).intersect(fx.watchlist(spark, d).select("ticker"))


@query("set_dict_override", "select ticker, case when ticker in (select ticker from fx_watchlist) then 'right' else 'left' end side from (select distinct p_brand ticker from part)")
def _(spark, d):
    left = fx.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct().withColumn("side", F.lit("left"))
    return J.override(left, fx.watchlist(spark, d).select("ticker", F.lit("right").alias("side")), "ticker")


@query("agg_distinct_tickers", "select count(distinct ticker) n from fx_holdings", i="n")
def _(spark, d):
    return fx.holdings(spark, d).select("ticker").distinct().agg(F.count("*").alias("n"))
