"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.llm.common import WORD, dropped, row_key, small, written

#: Weights that the sources get in turn, in code-point order, null last.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times the size of its source.
MOST = 3
#: Rows of one leaf of the reduction tree, and children of an inner node.
LEAF, FAN = 1024, 64
#: Copies of so many rows are broadcast to the documents; more are joined by one shuffle of the texts.
COPIES_ROWS = 500_000

#: Equal rows that stay in one leaf; more of them are spread over leaves.
RUN = 64

_NO_ID = -(1 << 63)  # stands for a null doc_id where pandas would make floats of all
_ROUNDED = "source string, bucket long, doc_id long, row_key long, size long, base long, p double, up boolean"


def source_targets(per: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """``per(source, rows, source_size)`` with target, by weighted shares with capped and reshared excess.

    The caps bind in the order of most*size/weight; the first source under the common level ends it,
    so one cumulative sum over the table of sources replaces repeated resharing.
    """
    turn = W.orderBy(F.col("source").asc_nulls_last())
    one = W.orderBy("knee", F.col("source").asc_nulls_last())
    before = one.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    table = F.array(*[F.lit(float(w)) for w in weights])
    everything = W.partitionBy()  # one row per source
    return (
        per.withColumn("weight", table[F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))).cast("int")])
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("knee", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("final", F.first(F.when(F.col("knee") >= F.col("level"), F.col("level")), ignorenulls=True).over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select("source", "rows", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), "cap")).alias("target"))
    )


def _trade(p_i: float, s_i: float, gain: float, loss: float, luck: float) -> float:
    """Words that i takes (or gives, if negative) from a partner that can give ``gain`` and take ``loss``."""
    a, b = min((1.0 - p_i) * s_i, gain), min(p_i * s_i, loss)
    return a if luck * (a + b) < b else -b


def _snap(x: float) -> float:
    return 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def round_fractions(p: np.ndarray, size: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Pivotal rounding that leaves at most one fraction, and keeps sum(p * size) and every expectation.

    ``size`` falls. Fractions are paired one after the other, in tiers of half of what is left. The one
    that a tier leaves over trades with all the smaller rows together, which makes it integral and shifts
    theirs a little; so what is left in the end belongs to the smallest row where that is possible.
    A row too large for the smaller ones in one direction goes the other way (the only step that chance
    doesn't decide: the sum comes before the expectation of such a row).
    """
    p = p.copy()
    live = np.flatnonzero((p > 0) & (p < 1))
    while len(live) > 1:
        tier, rest = live[: (len(live) + 1) // 2], live[(len(live) + 1) // 2 :]
        held = -1
        for j in tier.tolist():
            if held < 0:
                held = j
                continue
            words = _trade(p[held], size[held], p[j] * size[j], (1.0 - p[j]) * size[j], luck[j])
            p[held], p[j] = _snap(p[held] + words / size[held]), _snap(p[j] - words / size[j])
            held = j if 0.0 < p[j] < 1.0 else held if 0.0 < p[held] < 1.0 else -1
        if held >= 0:
            have, room = float(p[rest] @ size[rest]), float((1.0 - p[rest]) @ size[rest])
            words = _trade(p[held], size[held], have, room, luck[held])
            up, down = (1.0 - p[held]) * size[held], p[held] * size[held]
            if (have >= up) != (room >= down):  # one way only leaves nothing over
                words = up if have >= up else -down
            p[held] = _snap(p[held] + words / size[held])
            p[rest] = p[rest] * (1.0 - words / have) if words > 0 else 1.0 - (1.0 - p[rest]) * (1.0 + words / room)
            p[rest] = np.where(p[rest] < 1e-9, 0.0, np.where(p[rest] > 1 - 1e-9, 1.0, p[rest]))
        live = np.array([k for k in ([held] if held >= 0 else []) + rest.tolist() if 0.0 < p[k] < 1.0], np.int64)
        if held >= 0 and 0.0 < p[held] < 1.0:
            break  # the smaller rows had too few words: all of them are integral
    return p


def _pivot(seed: int, last: bool):
    """Rounds one node of the tree; the fraction that is left goes up, or is drawn at the root."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "row_key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        name = "\0null" if key[0] is None or key[0] != key[0] else f"s{key[0]}"
        luck = np.random.Generator(np.random.PCG64([seed, int(key[1]), *name.encode()])).random(len(rows) + 1)
        p = round_fractions(rows["p"].to_numpy(float), rows["size"].to_numpy(float), luck)
        up = (p > 0.0) & (p < 1.0)
        if last:
            p, up = np.where(up, luck[-1] < p, p).astype(float), np.zeros(len(p), bool)
        rows["p"], rows["up"] = p, up
        return rows[["source", "bucket", "doc_id", "row_key", "size", "base", "p", "up"]]

    return run


def _rounded(docs: DataFrame, weights: tuple, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their copies, targets by source), both written; a row is known by its doc_id and row_key."""
    sized = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_key(docs).alias("row_key"))
    rows = written(sized.groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("m")), "mix-sizes")
    per = written(rows.groupBy("source").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("size")).alias("source_size")), "mix-sums")
    targets = written(source_targets(per, weights, most), "mix-targets")
    wanted = small(targets.withColumnRenamed("source", "s"))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("rows") / LEAF)).cast("long")
    asked = (
        rows.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
        .join(wanted, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("ratio", ratio)
        .withColumn("base", F.floor(F.col("ratio") + 1e-12))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - F.col("base"))).otherwise(F.lit(0.0)))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_key", F.floor(F.col("turn") / RUN)), leaves))
        .select("source", "bucket", "doc_id", "row_key", "size", "base", "p", F.lit(True).alias("up"))
    )
    top = targets.agg(F.max(F.ceil(F.col("rows") / LEAF))).first()[0] or 1
    done, above, level, width = [], [], asked, int(top)
    while True:
        last = width <= 1
        out = written(level.groupBy("source", "bucket").applyInPandas(_pivot(seed + len(done), last), _ROUNDED), "mix-level")
        done.append(out.filter("not up"))
        above.append(out)
        if last:
            break
        level = out.filter("up").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        width = -(-width // FAN)
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionByName(more)
    if len(above) > 1:
        rounded = written(rounded, "mix-rounded")
        dropped(*above)
    dropped(rows, per)
    return rounded.withColumn("copies", F.col("base") + F.round("p").cast("long")), targets


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """Copies for every row of ``docs(doc_id, text, source)``, so that sources' words meet their targets.

    Every row of a source asks for target / source_size copies. The whole part is taken as it is; the
    fractions are rounded by pivotal sampling: two fractional rows trade words, in the direction that
    chance picks without bias, until one of them is 0 or 1. Leaves are hash buckets of a source with
    about LEAF rows, so a hot source has many; a leaf leaves one fractional row at most, its smallest
    where possible, and a tree of fan-in FAN combines those. A source's taken words miss its target by
    the share of one document, mostly a small one. Seeds come from the source and the node, rows are
    ordered by size, doc_id and content: reruns agree.

    Returns doc_id, size, source_size, target, taken, copies, source. Null text: size 0; rows of size 0
    get the whole part only, as do texts of white space only. Null source: a source of its own, ordered
    last. Null doc_ids stay null and repeated rows count apart (both are told apart by content, and equal
    rows are spread over leaves in runs of RUN). Long texts are counted whole. An empty table gives no
    rows. Columns of ``docs`` named like an output are not read.
    """
    rounded, targets = _rounded(docs, weights, most, seed)
    back = small(targets.withColumnRenamed("source", "s"))
    return rounded.join(back, F.col("source").eqNullSafe(F.col("s"))).select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"), "copies", "source",
    )


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` repeated as often as the mix takes them; columns stay as they are.

    A row meets its copies by doc_id and a hash of the whole row, so rows that share a doc_id (or have
    none) get their own; only rows that are equal throughout are interchangeable, and one of them stands
    for all copies of them. Texts move once, to the copies' keys; copies under a checked number of rows
    are broadcast instead, and no text moves. An empty table gives no rows.
    """
    rounded, _ = _rounded(docs, weights, most, seed)
    taken = rounded.groupBy("doc_id", "row_key").agg(F.sum("copies").alias("_mix_n"), F.count("*").alias("_mix_m")).filter("_mix_n > 0")
    taken = written(taken.select(F.col("doc_id").alias("_mix_id"), F.col("row_key").alias("_mix_key"), "_mix_n", "_mix_m"), "mix-taken")
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_mix_id"), row_key(docs).alias("_mix_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_doc"))
    keys = ["_mix_id", "_mix_key"]
    out = keyed.join(small(taken.filter("_mix_m = 1"), COPIES_ROWS), keys)
    if (repeated := written(taken.filter("_mix_m > 1"), "mix-repeated")).count():
        of_equal = keyed.join(small(repeated, COPIES_ROWS), keys).groupBy(*keys).agg(F.first("_mix_doc").alias("_mix_doc"), F.first("_mix_n").alias("_mix_n"), F.first("_mix_m").alias("_mix_m"))
        out = out.unionByName(of_equal.select(*out.columns))
    return out.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))).alias("_mix_copy"), "_mix_doc").select("_mix_doc.*")
