"""Window functions and recursions over daily series (ticker, dt, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def by():
    """Rows of a ticker by date."""
    return W.partitionBy("ticker").orderBy("dt")


def latest():
    return W.partitionBy("ticker").orderBy(F.col("dt").desc())


def whole():
    return W.partitionBy("ticker")


def rows(low: int, high: int = 0):
    return by().rowsBetween(low, high)


def simple_returns(prices: DataFrame) -> DataFrame:
    """close / previous close - 1, without the first row of a ticker."""
    before = F.lag("close").over(by())
    return prices.filter("close is not null").withColumn("ret", F.try_divide("close", before) - 1).filter("ret is not null")


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker."""
    return df.withColumn("_rn", F.row_number().over(latest())).filter(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(by()))


def full(value: Column, n: int) -> Column:
    """``value`` where the ticker has n rows so far."""
    return F.when(F.row_number().over(by()) >= n, value)


def moving_averages(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    out = bars
    for n in windows:
        out = out.withColumn(f"sma{n}", full(F.avg("close").over(rows(1 - n)), n))
    return out.withColumn("volume_sma10", full(F.avg("volume").over(rows(-9)), 10)) if "volume" in bars.columns else out


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = F.avg("close").over(rows(1 - n)), F.stddev_pop("close").over(rows(1 - n))
    return bars.withColumn("bb_mid", full(mid, n)).withColumn("bb_upper", full(mid + k * dev, n)).withColumn("bb_lower", full(mid - k * dev, n))


def smoothed(df: DataFrame, value: str, alpha: float, name: str, least: int) -> DataFrame:
    """s_t = d^t x_0 + a sum_(k=1..t) d^(t-k) x_k with d = 1-a, as a windowed sum of re-based blocks.

    Within a block of B rows the weights are d^-(k mod B); a block's end value is folded over the blocks
    of a ticker, of which there are few. Nothing overflows, and every step is a window or a join.
    """
    block, decay = 256, 1.0 - alpha
    t = F.row_number().over(by()) - 1
    marked = df.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / block)).withColumn("_k", F.col("_t") % block)
    term = F.when(F.col("_t") == 0, F.col(value)).otherwise(alpha * F.col(value)) * F.pow(F.lit(decay), -F.col("_k").cast("double"))
    inside = W.partitionBy("ticker", "_b").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumn("_own", F.pow(F.lit(decay), F.col("_k").cast("double")) * F.sum(term).over(inside))
    ends = local.groupBy("ticker", "_b").agg(F.max_by("_own", "_t").alias("_end"), F.count("*").alias("_n"))
    ends = ends.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("_b", "_end", "_n"))).alias("_e"))
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("before"))
    fold = lambda acc, x: F.struct((acc["s"] * F.pow(F.lit(decay), x["_n"].cast("double")) + x["_end"]).alias("s"), F.concat(acc["before"], F.array(acc["s"])).alias("before"))
    carried = ends.select("ticker", F.posexplode(F.aggregate("_e", zero, fold)["before"]).alias("_b", "_before"))
    joined = local.join(carried, ["ticker", "_b"])
    state = F.col("_own") + F.col("_before") * F.pow(F.lit(decay), (F.col("_k") + 1).cast("double"))
    return joined.withColumn(name, F.when(F.col("_t") >= least - 1, state)).drop("_t", "_b", "_k", "_own", "_before")


def ema(df: DataFrame, value: str, span: int, name: str, least: int | None = None) -> DataFrame:
    return smoothed(df, value, 2.0 / (span + 1), name, span if least is None else least)


def macd(bars: DataFrame) -> DataFrame:
    """macd (12/26), its 9-row signal from the first macd on, and their difference."""
    both = ema(ema(bars, "close", 12, "_fast"), "close", 26, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    signal = ema(both.filter("macd is not null"), "macd", 9, "macd_signal").select("ticker", "dt", "macd_signal")
    return both.drop("_fast", "_slow").join(signal, ["ticker", "dt"], "left").withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """100 - 100 / (1 + smoothed gains / smoothed losses), smoothing 1/n; 100 without losses."""
    step = F.col("close") - F.lag("close").over(by())
    moves = bars.withColumn("_up", F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0))).withColumn("_down", F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0)))
    both = smoothed(smoothed(moves, "_up", 1.0 / n, "_gain", n), "_down", 1.0 / n, "_loss", n)
    value = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide("_gain", "_loss")))
    return both.withColumn(f"rsi{n}", F.when(F.col("_gain").isNotNull(), value)).drop("_up", "_down", "_gain", "_loss")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """True range smoothed by 1/n from the mean of its first n rows."""
    before = F.lag("close").over(by())
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    ranged = numbered(bars.withColumn("tr", F.coalesce(true, F.col("high") - F.col("low"))), "_n")
    seeded = ranged.withColumn("_seed", F.when(F.col("_n") == n, F.avg("tr").over(rows(1 - n))).otherwise(F.col("tr")))
    later = smoothed(seeded.filter(F.col("_n") >= n), "_seed", 1.0 / n, f"atr{n}", 1).select("ticker", "dt", f"atr{n}")
    return ranged.drop("_n").join(later, ["ticker", "dt"], "left")


def crossings(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """entry where the fast average rises over the slow one, exit where it falls under it."""
    m = moving_averages(bars, (fast, slow))
    f, s = F.col(f"sma{fast}"), F.col(f"sma{slow}")
    pf, ps = F.lag(f).over(by()), F.lag(s).over(by())
    return m.withColumn("entry", F.coalesce((f > s) & (pf <= ps), F.lit(False))).withColumn("exit", F.coalesce((f < s) & (pf >= ps), F.lit(False)))


def ewma_variance(returns: DataFrame, decay: float = 0.94, first: int = 21) -> DataFrame:
    """var: the first ``first`` rows' population variance at row 0, then decay * var + (1-decay) * previous ret^2.

    Series under ``first`` rows keep the population variance of all their rows.
    """
    rn = numbered(returns, "_n").withColumn("_c", F.count("*").over(whole()))
    start = F.var_pop(F.when(F.col("_n") <= first, F.col("ret"))).over(whole())
    base = rn.withColumn("_v0", start).withColumn("_x", F.when(F.col("_n") == 1, F.col("_v0")).otherwise(F.pow(F.lag("ret").over(by()), 2)))
    out = smoothed(base, "_x", 1 - decay, "_s", 1)
    return out.withColumn("var", F.when(F.col("_c") < first, F.var_pop("ret").over(whole())).otherwise(F.col("_s"))).drop("_n", "_c", "_v0", "_x", "_s")


def drawdown(returns: DataFrame, key: str = "ticker") -> DataFrame:
    """cum (product of 1+ret) and its distance from the running peak; the peak doesn't include the start."""
    w = W.partitionBy(key).orderBy("dt").rowsBetween(W.unboundedPreceding, 0) if key else W.orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    out = returns.withColumn("cum", F.exp(F.sum(F.log1p("ret")).over(w)))
    return out.withColumn("drawdown", F.col("cum") / F.max("cum").over(w) - 1)


def trailing_moments(returns: DataFrame, n: int = 252) -> DataFrame:
    """skew and excess kurtosis (bias-corrected) of the n rows before each row, 0 with three or fewer; their count.

    Power sums run once over each ticker; a window's are the difference of two, so a row costs the same for any n.
    """
    from tideline.operators.moments import corrected_kurtosis, corrected_skew

    out, run = returns, by().rowsBetween(W.unboundedPreceding, -1)
    center = F.avg("ret").over(whole())
    out = out.withColumn("_x", F.col("ret") - center).withColumn("_k", F.row_number().over(by()) - 1)
    for p in range(1, 5):
        out = out.withColumn(f"_s{p}", F.coalesce(F.sum(F.pow("_x", p)).over(run), F.lit(0.0)))
    for p in range(1, 5):
        out = out.withColumn(f"_d{p}", F.col(f"_s{p}") - F.coalesce(F.lag(f"_s{p}", n).over(by()), F.lit(0.0)))
    c = F.least("_k", F.lit(n))
    m1, m2, m3, m4 = (F.try_divide(F.col(f"_d{p}"), c) for p in range(1, 5))
    var = m2 - m1 * m1
    third, fourth = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1, m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    g1, g2 = F.try_divide(third, F.pow(var, 1.5)), F.try_divide(fourth, var * var) - 3
    out = out.withColumn("n_before", c.cast("long")).withColumn("skew", F.when(c > 3, corrected_skew(g1, c)).otherwise(0.0)).withColumn("kurt", F.when(c > 3, corrected_kurtosis(g2, c)).otherwise(0.0))
    return out.drop("_x", "_k", *[f"_{x}{p}" for x in "sd" for p in range(1, 5)])


def window_ids(df: DataFrame, train: int, step: int, span: int) -> DataFrame:
    """Explodes the windows that each row is in: window w starts at row w*step and has ``span`` rows.

    An equi-join key in place of a range join: a row is in span/step windows at most.
    """
    rn = numbered(df, "_r").withColumn("_c", F.count("*").over(whole()))
    last = F.floor((F.col("_r") - 1) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("_r") - span) / step))
    out = rn.withColumn("w", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))
    return out.withColumn("pos", F.col("_r") - 1 - F.col("w") * step).filter((F.col("w") * step + span) <= F.col("_c")).drop("_r", "_c")


def last_array(bars: DataFrame, n: int = 30) -> DataFrame:
    """ticker and the last n closes, rounded to 2, oldest first."""
    kept = tail(bars, n).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("dt", "close"))).alias("s"))
    return kept.select("ticker", F.transform("s", lambda x: F.round(x["close"], 2)).alias("series"))


def forward_filled(spine: DataFrame, values: DataFrame) -> DataFrame:
    """ret of the last earlier row on every date of the ticker's spine, 0 before the first."""
    w = by().rowsBetween(W.unboundedPreceding, 0)
    return spine.join(values, ["ticker", "dt"], "left").withColumn("ret", F.coalesce(F.last("ret", ignorenulls=True).over(w), F.lit(0.0)))
