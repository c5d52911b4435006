"""Alignment, lookups and as-of joins as equi-joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast.
LOOKUP_ROWS = 1000


def lookup(table: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """Marks a table for broadcast if it has at most ``rows`` rows (counted); a larger one is joined as Spark sees fit."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def align_factors(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Returns with the factors of their date, and y = ret - rf."""
    return returns.join(factors, "dt").withColumn("y", F.col("ret") - F.col("rf"))


def align_inner(returns: DataFrame, k: int | None = None) -> DataFrame:
    """Rows on dates that all k tickers have: one count per date in place of k joins."""
    if k is None:
        k = returns.select("ticker").distinct().count()
    return returns.withColumn("_k", F.count("*").over(W.partitionBy("dt"))).filter(F.col("_k") == k).drop("_k")


def weighted_sum(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """dt, ret = sum of weight * ret with missing tickers as 0: an outer alignment is a group by date."""
    return returns.join(weights.select("ticker", "weight"), "ticker").groupBy("dt").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def with_benchmark(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """Returns with the benchmark's return of their date as ``bench``."""
    return returns.join(bench.select("dt", F.col("ret").alias("bench")), "dt")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def asof_forward(points: DataFrame, series: DataFrame, at: str = "eval_dt") -> DataFrame:
    """For each (ticker, at) the first row of the series on or after it: key, dt and row number.

    Points and rows are merged and sorted once per ticker; the next row is a window over what follows.
    """
    rows = series.select("ticker", F.col("dt").alias("_at"), F.lit(1).alias("_row"), F.col("dt").alias("_dt"), F.row_number().over(W.partitionBy("ticker").orderBy("dt")).alias("_rn"), F.lit(None).cast("date").alias(at))
    asks = points.select("ticker", F.col(at).alias("_at"), F.lit(0).alias("_row"), F.lit(None).cast("date").alias("_dt"), F.lit(None).cast("int").alias("_rn"), F.col(at))
    w = W.partitionBy("ticker").orderBy("_at", "_row").rowsBetween(0, W.unboundedFollowing)
    both = rows.unionByName(asks).withColumn("hit", F.first(F.when(F.col("_row") == 1, F.struct("_dt", "_rn")), ignorenulls=True).over(w))
    return both.filter("_row = 0").select("ticker", at, F.col("hit._dt").alias("dt"), F.col("hit._rn").alias("rn"))


def asof_backward(snapshots: DataFrame, as_of: str, low: int, high: int) -> DataFrame:
    """The newest snapshot whose age in days is between low and high."""
    age = F.datediff(F.to_date(F.lit(as_of)), "dt")
    return snapshots.withColumn("age", age).filter(F.col("age").between(low, high)).orderBy("age").limit(1)


def override(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both with unique keys; the right one wins."""
    both = left.withColumn("_p", F.lit(0)).unionByName(right.withColumn("_p", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_p")))).filter("_r = 1").drop("_p", "_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_p")))).filter("_r = 1").drop("_p", "_r")


def union_distinct(frames: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys in order of first appearance over the frames: key, place.

    Keys are sorted in ranges; a place is the key's one in its range after the counts of the ranges before.
    """
    from tideline.plans.scratch import written

    all_rows = None
    for k, f in enumerate(frames):
        own = f.select(F.col(key), F.lit(k).alias("_k"))
        all_rows = own if all_rows is None else all_rows.unionByName(own)
    first = all_rows.groupBy(key).agg(F.min("_k").alias("_k"))
    ranges = written(first.repartitionByRange("_k", key).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    heads = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_head"))
    own = F.row_number().over(W.partitionBy("_part").orderBy("_k", key))
    return ranges.withColumn("_own", own).join(heads, "_part").select(key, (F.col("_head") + F.col("_own")).alias("place"))
