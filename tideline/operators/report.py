"""Report sections as small relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.operators import portfolio as P

#: Alert: metric, threshold, direction (fixed values).
THRESHOLDS = (("var_95_cf", 0.05, "above"), ("cvar_ratio", 1.8, "above"), ("max_drawdown", 0.20, "above"), ("max_position", 0.30, "above"), ("hhi", 0.25, "above"), ("beta", 1.5, "above"), ("sharpe", 0.5, "below"), ("daily_loss", 0.03, "above"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their place in an order; for report-sized relations."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order)))


def top_positions(holdings: DataFrame, n: int = 10, asset_class: str = "equity") -> DataFrame:
    rows = holdings.filter(F.col("asset_class") == asset_class).groupBy("ticker").agg(F.sum("market_value_eur").alias("mv"))
    return rows.orderBy(F.round("mv", 2).desc(), "ticker").limit(n)


def news_quality(rows: DataFrame) -> DataFrame:
    """Per source: articles seen, and those with a title or description."""
    full = (F.length(F.coalesce("title", F.lit(""))) > 0) | (F.length(F.coalesce("description", F.lit(""))) > 0)
    return rows.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(full).alias("kept"))


def alerts(metrics: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """A metrics row as (metric, value, threshold, status)."""
    have = [t for t in thresholds if t[0] in metrics.columns]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.lit(how).alias("direction")) for m, t, how in have])
    out = metrics.select(F.inline(rows))
    breach = F.when(F.col("direction") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return out.withColumn("status", P.traffic_light(F.col("value"), breach)).drop("direction")


def overall(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.agg(F.when(F.max(F.col("status") == "RED"), "RED").otherwise("GREEN").alias("overall"))


def risk_card(returns: DataFrame, holdings: DataFrame, bench: DataFrame, window: int = 252) -> DataFrame:
    """One row of portfolio metrics from daily returns, holdings and a benchmark."""
    from tideline.operators import joins as J
    from tideline.operators import moments as M
    from tideline.operators import series as X

    weights = P.by_ticker(holdings)
    daily = J.weighted_sum(X.tail(returns, window), weights).withColumn("ticker", F.lit("P"))
    one = lambda df: df.withColumn("ticker", F.lit("P"))
    dd = X.drawdown(daily).groupBy("ticker").agg((-F.min("drawdown")).alias("max_drawdown"))
    loss = daily.groupBy("ticker").agg((-F.max_by("ret", "dt")).alias("daily_loss"))
    parts = [M.historical_var(daily, (0.95,)), M.cvar(daily), M.cornish_fisher_var(daily).withColumnRenamed("var_cf", "var_95_cf"), M.sharpe(daily), dd, loss, M.beta(J.with_benchmark(daily, bench)), one(P.concentration(holdings))]
    card = one(P.nav(holdings))
    for p in parts:
        card = card.join(p, "ticker", "left")
    return card.withColumn("cvar_ratio", F.try_divide("cvar", "var_95")).drop("ticker")


def beside(now: DataFrame, before: DataFrame, key: str = "metric") -> DataFrame:
    """Values with those of an earlier snapshot and the change."""
    old = before.select(key, F.col("value").alias("before"))
    return now.join(old, key, "left").withColumn("change", F.col("value") - F.col("before"))


def flagged(status: DataFrame) -> DataFrame:
    """Series with a data-quality flag."""
    return status.filter("flag <> ''")


def html(title: str, sections: dict[str, DataFrame]) -> str:
    """An HTML page of the sections, with all their rows: a page is made of sections that are small by themselves."""
    from html import escape

    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in sections.items():
        out.append(f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{escape('N/A' if v is None else f'{v:.4f}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in df.toLocalIterator()]
        out.append("</table>")
    return "".join(out) + "</body></html>"
