"""Weights, rebalancing, candidates, paper-trading rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import portfolio as P


def candidate_verdict(weight: Column, gain: Column) -> Column:
    return F.when((weight > 0.006) & (gain > 0), "add").when(weight > 0.006, "neutral").otherwise("skip")


def seeded_sample(rows: DataFrame, seed: str, n: int) -> DataFrame:
    """n rows in the order of md5(ticker + seed): a shuffle that any engine repeats."""
    return rows.withColumn("k", F.md5(F.concat(F.col("ticker"), F.lit(seed)).cast("binary"))).orderBy("k").limit(n)


def expand_universe(permanent: DataFrame, pool: DataFrame, seed: str, size: int) -> DataFrame:
    """The permanent tickers, filled up to ``size`` by a seeded sample of the pool."""
    have = permanent.select("ticker").distinct()
    need = max(0, size - have.count())
    extra = seeded_sample(pool.select("ticker").distinct().join(have, "ticker", "left_anti"), seed, need).select("ticker")
    return have.withColumn("origin", F.lit("permanent")).unionByName(extra.withColumn("origin", F.lit("sample")))


def promote(screened: DataFrame, watch: DataFrame) -> DataFrame:
    """Screened tickers with a robust BUY or SELL that aren't on the watchlist."""
    return screened.filter("robust in ('BUY', 'SELL')").join(watch, "ticker", "left_anti")


def prune(watch: DataFrame, signals: DataFrame, as_of: Column, grace: int = 30) -> DataFrame:
    """Watchlist rows with ``keep`` and the rule that removes: promoted ones on SELL, or not BUY beyond the grace days."""
    age = F.datediff(as_of, S.note_date("notes"))
    joined = watch.join(signals, "ticker", "left").withColumn("robust", F.coalesce("robust", F.lit("HOLD")))
    rule = F.when(~S.is_promoted("notes"), None).when(F.col("robust") == "SELL", "A").when((F.col("robust") != "BUY") & (age > grace), "B")
    return joined.withColumn("rule", rule).withColumn("keep", rule.isNull())


def gate(positions: Column, var: Column, beta: Column, drawdown: Column, limits: tuple[float, ...] = (10, 0.05, 1.5, 0.10)) -> Column:
    """The first risk gate that fails, or 'ok'."""
    return F.when(positions > limits[0], "positions").when(var > limits[1], "var").when(beta > limits[2], "beta").when(drawdown > limits[3], "drawdown").otherwise("ok")


def exits(held: DataFrame, signals: DataFrame, stop: float = 0.15) -> DataFrame:
    """Held tickers to sell: a SELL signal, or a loss beyond the stop; ticker, reason."""
    sells = held.join(signals.filter("signal = 'SELL' or robust = 'SELL'"), "ticker", "left_semi").select("ticker", F.lit("signal").alias("reason"))
    stops = held.filter(F.col("plpc") < -stop).join(sells, "ticker", "left_anti").select("ticker", F.lit("stop_loss").alias("reason"))
    return sells.unionByName(stops)


def order_weights(buys: DataFrame, cap: float = 0.15, floor: float = 0.01) -> DataFrame:
    """Weights in proportion to ir (floored), capped without renormalising."""
    ir = F.greatest(F.coalesce("ir", F.lit(0.0)), F.lit(floor))
    return buys.withColumn("weight", F.least(ir / F.sum(ir).over(P.every()), F.lit(cap)))


def budget_fold(orders: DataFrame, equity: float) -> DataFrame:
    """Integer quantities under one budget, in the order of ``place``: an order that can't buy a share is skipped.

    The order book of one rebalancing is small (positions are capped), so the fold runs over one array.
    """
    rows = orders.agg(F.sort_array(F.collect_list(F.struct("place", "ticker", "weight", "price"))).alias("o"))
    zero = F.struct(F.lit(float(equity)).alias("left"), F.array().cast("array<struct<ticker: string, qty: bigint, value: double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        qty = F.floor(F.least(equity * x["weight"], acc["left"]) / x["price"])
        spend = qty * x["price"]
        item = F.struct(x["ticker"].alias("ticker"), qty.alias("qty"), spend.alias("value"))
        return F.when(qty >= 1, F.struct((acc["left"] - spend).alias("left"), F.concat(acc["out"], F.array(item)).alias("out"))).otherwise(acc)

    return rows.select(F.inline(F.aggregate("o", zero, step)["out"]))


def rebalance(current: DataFrame, optimal: DataFrame, cgt: Column) -> DataFrame:
    """ticker, delta and tier where both weights exist, by tier and size of the change."""
    joined = current.join(optimal.select("ticker", F.col("weight").alias("target")), "ticker")
    out = joined.withColumn("delta", F.col("target") - F.col("weight")).withColumn("tier", P.tier(F.col("delta"), cgt))
    return out.withColumn("place", F.row_number().over(W.orderBy("tier", F.round(F.abs("delta"), 9).desc(), "ticker")))


def capped_weights(scores: DataFrame, cap: float = 0.20, rounds: int = 30) -> DataFrame:
    """Score-proportional weights; what exceeds the cap goes to the rest by spare room, then all are renormalised."""
    base = scores.agg(F.sort_array(F.collect_list(F.struct("ticker", "score"))).alias("s"), F.sum("score").alias("t"))
    first = base.select(F.transform("s", lambda x: x["ticker"]).alias("names"), F.transform("s", lambda x: x["score"] / F.col("t")).alias("w"))

    def turn(w: Column, _: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        over = total(F.transform(w, lambda x: F.greatest(x - cap, F.lit(0.0))))
        room = total(F.transform(w, lambda x: F.greatest(cap - x, F.lit(0.0))))
        return F.when((over < 1e-12) | (room < 1e-12), F.transform(w, lambda x: F.least(x, F.lit(cap)))).otherwise(F.transform(w, lambda x: F.when(x > cap, cap).otherwise(x + over * (cap - x) / room)))

    folded = first.select("names", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), "w", turn).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return folded.select("names", F.transform("w", lambda x: x / total).alias("w")).select(F.inline(F.arrays_zip(F.col("names").alias("ticker"), F.col("w").alias("weight")))).toDF("ticker", "weight")


def signal_scores(robust: DataFrame) -> DataFrame:
    """Eligible robust BUYs and psr * ir_d * (1 + 0.2 consistency / windows)."""
    ok = robust.filter("robust = 'BUY' and psr >= 0.65 and deflated > 0")
    return ok.withColumn("score", F.col("psr") * F.col("ir_d") * (1 + 0.2 * F.col("consistency") / F.greatest("n_windows", F.lit(1))))


def turnover(weights: DataFrame, by: str = "w") -> DataFrame:
    """Half the absolute weight change against the window before, by name; the first window counts 1."""
    cells = weights.select(by, "ticker", "weight")
    moved = cells.select(F.col(by), "ticker", F.col("weight").alias("now"), F.lit(0.0).alias("was")).unionByName(cells.select((F.col(by) + 1).alias(by), "ticker", F.lit(0.0).alias("now"), F.col("weight").alias("was")))
    per = moved.groupBy(by, "ticker").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    edge = cells.agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    out = per.groupBy(by).agg((F.sum(F.abs(F.col("now") - F.col("was"))) / 2).alias("turnover")).join(F.broadcast(edge), F.col(by).between(F.col("lo"), F.col("hi")))
    return out.select(by, F.when(F.col(by) == F.col("lo"), 1.0).otherwise(F.col("turnover")).alias("turnover"))


def topk_turnover(ranked: DataFrame, by: str, k: int) -> DataFrame:
    """Share of the top k that is new against the period before."""
    sets = ranked.filter(F.col("place") <= k).groupBy(by).agg(F.collect_set("ticker").alias("s"))
    before = F.lag("s").over(W.orderBy(by))
    return sets.select(by, (1 - F.size(F.array_intersect("s", before)) / float(k)).alias("turnover"), before.isNotNull().alias("ok")).filter("ok").drop("ok")
