"""Indicator bundles and scored signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import series as X


def bundle(bars: DataFrame, least: int = 30) -> DataFrame:
    """The last row of each ticker with at least ``least`` rows: averages, MACD, RSI, bands, ranges, volume."""
    out = X.moving_averages(bars)
    for more, names in ((X.macd(bars), ["macd", "macd_signal"]), (X.rsi(bars), ["rsi14"]), (X.bollinger(bars), ["bb_mid", "bb_upper", "bb_lower"])):
        out = out.join(more.select("ticker", "dt", *names), ["ticker", "dt"])
    return X.tail(out.withColumn("_c", F.count("*").over(X.whole())).filter(F.col("_c") >= least).drop("_c"), 1)


def scored(last: DataFrame) -> DataFrame:
    """Rules with weights; missing values skip their rule, zero counts as missing for prices and volume."""
    have = lambda *cs: [F.coalesce(F.col(c), F.lit(0.0)) != 0 for c in cs]
    both = lambda xs: xs[0] & xs[1] if len(xs) > 1 else xs[0]
    sign = lambda a, b, w: F.when(F.col(a) > F.col(b), w).otherwise(-w)

    def rule(ok: Column, score: Column) -> Column:
        return F.when(ok, score)

    rsi = F.when(F.col("rsi14") < 30, 1.5).when(F.col("rsi14") > 70, -1.5).otherwise(0.0)
    band = F.when(F.col("close") <= F.col("bb_lower"), 1.0).when(F.col("close") >= F.col("bb_upper"), -1.0)
    volume = F.when(F.col("volume") / F.nullif("volume_sma10", F.lit(0.0)) > 1.5, 0.5)
    rules = {
        "trend": rule(both(have("sma50", "sma200")), sign("sma50", "sma200", 1.0)),
        "price": rule(both(have("close", "sma20")), sign("close", "sma20", 0.5)),
        "macd": rule(F.col("macd").isNotNull() & F.col("macd_signal").isNotNull(), sign("macd", "macd_signal", 1.0)),
        "rsi": rule(F.col("rsi14").isNotNull(), rsi),
        "bands": rule(both(have("bb_lower", "bb_upper")), band),
        "volume": rule(both(have("volume", "volume_sma10")), volume),
    }
    count = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in rules.values()), F.lit(0))
    total = sum((F.coalesce(r, F.lit(0.0)) for r in rules.values()), F.lit(0.0))
    label = lambda test: F.array_compact(F.array(*[F.when(test(r), F.lit(n)) for n, r in rules.items()]))
    return last.select("ticker", label(lambda r: r > 0).alias("bullish"), label(lambda r: r < 0).alias("bearish"), label(lambda r: r == 0).alias("neutral"), F.when(count > 0, total / count).otherwise(0.0).alias("score"))
