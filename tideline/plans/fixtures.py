"""Market-like relations derived from the star-schema tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")
_PRIORITY = dict(zip(FACTORS, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
FX = {"USD": 0.92, "GBP": 1.17, "AUD": 0.59, "EUR": 1.0}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _close() -> list:
    price = F.round(100 + 10 * F.log(F.sum("l_extendedprice") / F.sum("l_quantity")), 6)
    return [price.alias("close"), F.sum("l_quantity").alias("volume")]


def prices(spark: SparkSession, d: str) -> DataFrame:
    """ticker, dt, close, volume: a brand per ticker, sparse dates."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    lines = table(spark, d, "lineitem").withColumn("dt", F.to_date("l_shipdate"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "dt").agg(*_close())


def prices_region(spark: SparkSession, d: str) -> DataFrame:
    """The same with a region per ticker: five dense series."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    where = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", F.col("r_name").alias("ticker"))
    lines = table(spark, d, "lineitem").withColumn("dt", F.to_date("l_shipdate"))
    return lines.join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("ticker", "dt").agg(*_close())


def returns(spark: SparkSession, d: str) -> DataFrame:
    from tideline.operators.series import simple_returns

    return simple_returns(prices(spark, d)).select("ticker", "dt", F.round("ret", 9).alias("ret"))


def returns_region(spark: SparkSession, d: str) -> DataFrame:
    from tideline.operators.series import simple_returns

    return simple_returns(prices_region(spark, d)).select("ticker", "dt", F.round("ret", 9).alias("ret"))


def factors(spark: SparkSession, d: str) -> DataFrame:
    """dt, five factor returns and rf from order priorities."""
    value = lambda k: F.round(F.coalesce(F.log(F.avg(F.when(F.col("o_orderpriority") == k, F.col("o_totalprice")))), F.lit(12.0)) * 0.01 - 0.12, 9)
    orders = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("dt"))
    return orders.agg(*[value(k).alias(c) for c, k in _PRIORITY.items()]).withColumn("rf", F.lit(0.0001))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """ticker, dt, ret, factors, rf, y: returns with the factors of their date and the excess return."""
    from tideline.operators.joins import align_factors

    return align_factors(returns(spark, d), factors(spark, d))


def _owned(lines: DataFrame) -> DataFrame:
    money = lambda e, n: F.round(F.sum(F.expr(e)), 2).alias(n)
    return lines.groupBy("ticker", "platform", "asset_class", "currency").agg(
        money("l_quantity", "quantity"), money("l_extendedprice", "mv_native"), money("l_extendedprice * (1 - l_discount) * (1 + l_tax)", "cost_native")
    )


def holdings(spark: SparkSession, d: str) -> DataFrame:
    """ticker, platform, asset_class, currency, quantity, mv_native, cost_native."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    flag = F.col("l_returnflag")
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _owned(
        lines.withColumn("platform", F.when(flag == "A", "IBKR").when(flag == "N", "T212").otherwise("ETORO"))
        .withColumn("asset_class", F.expr("case when right(ticker, 1) in ('1', '2', '3') then 'equity' when right(ticker, 1) = '4' then 'bond' else 'gold' end"))
        .withColumn("currency", F.when(flag == "A", "USD").when(flag == "N", "GBP").otherwise("EUR"))
    )


def holdings_eur(spark: SparkSession, d: str) -> DataFrame:
    """holdings in EUR with market_value_eur, cost_basis_eur and the weight in the whole portfolio."""
    from tideline.operators.portfolio import to_eur, with_weight

    return with_weight(to_eur(holdings(spark, d), fx(spark)))


def fx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FX.items()), "currency string, rate_eur double")


def _bars(spark: SparkSession, d: str, unit: str) -> DataFrame:
    from tideline.streaming.bars import to_bars

    return to_bars(table(spark, d, "events").select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price")), unit)


def bars_h(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d, "hour")


def bars_d(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d, "day").withColumn("dt", F.to_date("ts"))


def watchlist(spark: SparkSession, d: str) -> DataFrame:
    """ticker, weight, notes, asset_class, currency: brands whose number is even are notes of promotion."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    k = F.expr("cast(replace(ticker, 'Brand#', '') as int)")
    note = F.when(k % 2 == 0, F.format_string("FF5 signal=BUY t=%s IR=%s [1998-0%s-15]", (k % 4 + 1).cast("string"), (k % 3).cast("string"), (k % 9 + 1).cast("string"))).otherwise(F.lit("manual"))
    return part.filter(k % 5 != 0).select("ticker", (k / 100.0).alias("weight"), note.alias("notes"), F.when(k % 7 == 0, F.lit(None)).otherwise(F.when(k % 4 == 0, "bond").otherwise("equity")).alias("asset_class"), F.lit("USD").alias("currency"))


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """id, dt, recommendation, accurate, ret from labels and documents."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), F.expr("date_add(date'1998-01-01', cast(doc_id % 200 as int))").alias("dt"), F.col("source").alias("ticker"), F.col("lang").alias("recommendation"), F.col("quality").cast("long").alias("accurate"))


SQL: dict[str, str] = {
    "fx_prices": "select p_brand ticker, cast(l_shipdate as date) dt, round(100+10*ln(sum(l_extendedprice)/sum(l_quantity)),6) as close, sum(l_quantity) volume from lineitem join part on l_partkey=p_partkey group by 1,2",
    "fx_prices_region": "select r_name ticker, cast(l_shipdate as date) dt, round(100+10*ln(sum(l_extendedprice)/sum(l_quantity)),6) as close, sum(l_quantity) volume from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by 1,2",
    "fx_returns": "select ticker, dt, round(ret,9) ret from (select ticker, dt, close/lag(close) over (partition by ticker order by dt)-1 ret from fx_prices) where ret is not null",
    "fx_returns_region": "select ticker, dt, round(ret,9) ret from (select ticker, dt, close/lag(close) over (partition by ticker order by dt)-1 ret from fx_prices_region) where ret is not null",
    "fx_factors": "select cast(o_orderdate as date) dt, " + ", ".join(f"round(coalesce(ln(avg(case when o_orderpriority='{k}' then o_totalprice end)),12.0)*0.01-0.12,9) {c}" for c, k in _PRIORITY.items()) + ", 0.0001::double rf from orders group by 1",
    "fx_aligned": "select r.ticker, r.dt, r.ret, f.mkt_rf, f.smb, f.hml, f.rmw, f.cma, f.rf, r.ret-f.rf y from fx_returns r join fx_factors f on r.dt=f.dt",
    "fx_holdings": "select p_brand ticker, case l_returnflag when 'A' then 'IBKR' when 'N' then 'T212' else 'ETORO' end platform, case when right(p_brand,1) in ('1','2','3') then 'equity' when right(p_brand,1)='4' then 'bond' else 'gold' end asset_class, case l_returnflag when 'A' then 'USD' when 'N' then 'GBP' else 'EUR' end currency, round(sum(l_quantity),2) quantity, round(sum(l_extendedprice),2) mv_native, round(sum(l_extendedprice*(1-l_discount)*(1+l_tax)),2) cost_native from lineitem join part on l_partkey=p_partkey group by 1,2,3,4",
    "fx_fx": "select * from (values ('USD',0.92::double),('GBP',1.17::double),('AUD',0.59::double),('EUR',1.0::double)) t(currency, rate_eur)",
    "fx_eur": "select ticker, platform, asset_class, currency, quantity, mv_native*rate_eur market_value_eur, cost_native*rate_eur cost_basis_eur, mv_native*rate_eur/sum(mv_native*rate_eur) over () weight from fx_holdings join fx_fx using(currency)",
    "fx_bars_h": "select event_type ticker, date_trunc('hour', ts) ts, arg_min(value, ts) as open, max(value) high, min(value) low, arg_max(value, ts) as close, count(*) volume from events group by 1,2",
    "fx_bars_d": "select event_type ticker, cast(date_trunc('day', ts) as timestamp) ts, arg_min(value, ts) as open, max(value) high, min(value) low, arg_max(value, ts) as close, count(*) volume, cast(ts as date) dt from events group by 1, 2, cast(ts as date)",
    "fx_watchlist": "select ticker, k/100.0::double weight, case when k%2=0 then concat('FF5 signal=BUY t=',cast(k%4+1 as varchar),' IR=',cast(k%3 as varchar),' [1998-0',cast(k%9+1 as varchar),'-15]') else 'manual' end notes, case when k%7=0 then null when k%4=0 then 'bond' else 'equity' end asset_class, 'USD' currency from (select distinct p_brand ticker, cast(replace(p_brand,'Brand#', '') as int) k from part) where k%5<>0",
    "fx_suggestions": "select d.doc_id id, cast(date '1998-01-01' + cast(d.doc_id%200 as int) as date) dt, source ticker, lang recommendation, cast(quality as bigint) accurate from documents d left join labels l on d.doc_id=l.doc_id",
}


def oracle(body: str) -> str:
    """``body`` with the derived relations that it names, and those they name, as common table expressions."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(SQL[name])
                used.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in used) + "\n" if used else "") + body
