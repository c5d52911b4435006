"""Walk-forward comparison of mean estimates: windows of dates, their moments as differences of cumulative block sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.kernels import critical_line as L
from tideline.kernels.paths import psd
from tideline.operators.allocation import turnover
from tideline.operators.walk import oos_metrics

KINDS = ("implied", "history", "equal")


def numbered(rows: DataFrame, step: int) -> DataFrame:
    """``rows`` with their date's number d (one row per date of all series is ranked), block b = d div step."""
    dates = rows.select("dt").distinct().withColumn("d", F.row_number().over(W.orderBy("dt")) - 1)
    return rows.join(dates, "dt").withColumn("b", F.floor(F.col("d") / step).cast("long"))


def block_grams(rows: DataFrame, early: int = 5, step: int = 63) -> DataFrame:
    """Per pair of assets a <= c and block: rows in common, sums, sums of products; on the diagonal also sums of y and the block's first rows."""
    x, z = rows.select(F.col("ticker").alias("a"), "dt", "b", "d", F.col("ret").alias("x"), "y"), rows.select(F.col("ticker").alias("c"), "dt", F.col("ret").alias("z"))
    own = F.col("a") == F.col("c")
    return x.join(z, "dt").filter("a <= c").groupBy("a", "c", "b").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("z").alias("sz"), F.sum(F.expr("x * z")).alias("sxz"), F.sum(F.when(own, F.col("y"))).alias("sy"), F.count_if(own & (F.col("d") % step < early)).alias("head"))


def window_grams(grams: DataFrame, blocks: int, train: int) -> DataFrame:
    """The same sums over the ``train`` blocks before each block b: a cumulative sum over blocks less the one ``train`` blocks before."""
    sums = ["n", "sx", "sz", "sxz", "sy"]
    grid = grams.select("a", "c").distinct().select("a", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks).cast("long"))).alias("b"))
    full = grid.join(grams, ["a", "c", "b"], "left")
    w = W.partitionBy("a", "c").orderBy("b")
    run = full.select("a", "c", "b", *[F.coalesce(F.sum(s).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(s) for s in sums], F.coalesce("head", F.lit(0)).alias("head"))
    return run.select("a", "c", "b", *[(F.col(s) - F.lag(s, train).over(w)).alias(s) for s in sums], F.lag("head", train).over(w).alias("head")).filter(F.col("b") >= train)


def _weights(rf: float, least_common: int):
    def run(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                names = [x["ticker"] for x in r["assets"]]
                n, at = len(names), {t: k for k, t in enumerate(names)}
                cov = np.zeros((n, n))
                for x in r["cells"]:
                    if x["a"] in at and x["c"] in at and x["n"] >= least_common:
                        i, j = at[x["a"]], at[x["c"]]
                        cov[i, j] = cov[j, i] = 252 * (x["sxz"] - x["sx"] * x["sz"] / x["n"]) / (x["n"] - 1)
                cov = psd(cov, 1e-8)
                low = max(0.001, 0.5 / n)
                high = min(1.0, max(min(0.4, 5 / n), 2 * low))
                for kind in KINDS:
                    w = np.full(n, 1 / n)
                    if kind != "equal" and (c := L.corners(mu := np.array([x[kind] for x in r["assets"]]), cov, low, high)) is not None:
                        w = L.tangency(c, mu, cov, rf)
                    out += [(r["b"], kind, n, t, float(v)) for t, v in zip(names, w)]
            yield pd.DataFrame(out, columns=["b", "kind", "assets", "ticker", "weight"])

    return run


def window_weights(rows: DataFrame, train: int, step: int, least: int, rf: float, fewest: int = 5, least_common: int = 20) -> DataFrame:
    """b, kind, assets, ticker, weight of every window whose block b is whole: a problem per row, solved in tasks."""
    blocks = rows.agg(F.floor((F.max("d") + 1) / step)).first()[0] or 0  # whole blocks of dates
    sums = window_grams(block_grams(rows, step=step), blocks, train // step).filter(F.col("b") < blocks)
    own = sums.filter((F.col("a") == F.col("c")) & (F.col("n") >= least) & (F.col("head") > 0))
    implied = F.when(F.col("n") >= 60, rf + 252 * F.col("sy") / F.col("n")).otherwise(252 * F.col("sx") / F.col("n"))
    assets = own.groupBy("b").agg(F.sort_array(F.collect_list(F.struct(F.col("a").alias("ticker"), implied.alias("implied"), (252 * F.col("sx") / F.col("n")).alias("history")))).alias("assets")).filter(F.size("assets") >= fewest)
    cells = sums.filter("n > 1").groupBy("b").agg(F.collect_list(F.struct("a", "c", "n", "sx", "sz", "sxz")).alias("cells"))
    return assets.join(cells, "b").mapInPandas(_weights(rf, least_common), "b long, kind string, assets long, ticker string, weight double")


def walk_forward(aligned: DataFrame, train: int = 756, step: int = 63, least: int = 252, rf: float = 0.035, fewest: int = 5) -> DataFrame:
    """Per window and kind of mean (implied by factors, historical, equal weights): what the weights earned in the block after.

    Windows are blocks of ``step`` dates with the ``train`` dates (a multiple of ``step``) before them; assets need
    ``least`` rows of those and one in the first five dates. Covariances are those of common dates (under 20: 0).
    In the block after, a date without a row repeats the asset's last return there, before the first it is 0.

    window (from 0), train_start, train_end, test_start, test_end, kind, assets, ann_ret, ann_vol, sharpe, max_dd,
    turnover (half the absolute change against the window before, 1 in the first).
    """
    from tideline.plans.scratch import written

    rows = written(numbered(aligned.select("ticker", "dt", "ret", "y"), step), "walk-rows")
    weights = written(window_weights(rows, train, step, least, rf, fewest), "walk-weights")
    dates = rows.select("dt", "d", "b").distinct()
    cells = weights.select("b", "ticker").distinct().join(dates, "b").join(rows.select("ticker", "dt", "ret"), ["ticker", "dt"], "left")
    last = F.last("ret", ignorenulls=True).over(W.partitionBy("b", "ticker").orderBy("dt").rowsBetween(W.unboundedPreceding, 0))
    filled = cells.select("b", "ticker", "dt", F.coalesce(last, F.lit(0.0)).alias("ret"))
    port = weights.join(filled, ["b", "ticker"]).groupBy("b", "kind", "assets", "dt").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    earned = oos_metrics(port.select(F.struct("b", "kind", "assets").alias("ticker"), "dt", "ret"), rf).select("ticker.*", "ann_ret", "ann_vol", "sharpe", F.col("max_drawdown").alias("max_dd"))
    moved = None
    for kind in KINDS:
        part = turnover(weights.filter(F.col("kind") == kind), "b").withColumn("kind", F.lit(kind))
        moved = part if moved is None else moved.unionByName(part)
    edge = dates.groupBy("b").agg(F.min("dt").alias("start"), F.max("dt").alias("end"))
    span = edge.select("b", F.col("start").alias("test_start"), F.col("end").alias("test_end")).join(edge.select((F.col("b") + train // step).alias("b"), F.col("start").alias("train_start")), "b").join(edge.select((F.col("b") + 1).alias("b"), F.col("end").alias("train_end")), "b")
    out = earned.join(moved, ["b", "kind"]).join(span, "b")
    return out.select((F.col("b") - train // step).alias("window"), "train_start", "train_end", "test_start", "test_end", "kind", "assets", "ann_ret", "ann_vol", "sharpe", "max_dd", "turnover")
