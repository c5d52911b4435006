"""Cholesky factors of pair tables in blocks: a round per block column, each made of joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Assets of a block; jitters of the diagonal that are tried in turn.
BLOCK = 64
JITTERS = (0.0, *(10.0**k for k in range(-10, -3)))


def _blocks(cells: DataFrame, names: DataFrame, size: int, jitter: float) -> DataFrame:
    """bi, bj, v: lower blocks as flat arrays; missing cells are 0, places beyond the last asset 1 on the diagonal."""
    i, j = (names.select(F.col("name").alias(c), F.col("place").alias(f"p{c}")) for c in "ab")
    placed = cells.join(i, "a").join(j, "b").filter("pa >= pb").withColumn("v", F.col("value") + F.when(F.col("pa") == F.col("pb"), jitter).otherwise(0.0))
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    held = placed.groupBy(block("pa").alias("bi"), block("pb").alias("bj")).agg(F.collect_list(F.struct((F.col("pa") % size).alias("i"), (F.col("pb") % size).alias("j"), "v")).alias("cells"), F.max("pa").alias("last"))

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                m = np.zeros((size, size))
                for x in r["cells"]:
                    m[x["i"], x["j"]] = x["v"]
                if r["bi"] == r["bj"]:
                    m += np.tril(m, -1).T
                    rest = np.arange(r["last"] - r["bi"] * size + 1, size)
                    m[rest, rest] = 1.0
                out.append((r["bi"], r["bj"], m.ravel()))
            yield pd.DataFrame(out, columns=["bi", "bj", "v"])

    return held.mapInPandas(run, "bi int, bj int, v array<double>")


def _factor(frames):
    for frame in frames:
        out = []
        for bi, v in zip(frame["bi"], frame["v"]):
            m = np.array(v).reshape(int(len(v) ** 0.5), -1)
            try:
                out.append((bi, bi, np.linalg.cholesky(m).ravel()))
            except np.linalg.LinAlgError:
                out.append((bi, bi, None))
        yield pd.DataFrame(out, columns=["bi", "bj", "v"])


def _panel(frames):
    for frame in frames:
        out = []
        for bi, bj, v, top in zip(frame["bi"], frame["bj"], frame["v"], frame["top"]):
            n = int(len(v) ** 0.5)
            out.append((bi, bj, np.linalg.solve(np.array(top).reshape(n, n), np.array(v).reshape(n, n).T).T.ravel()))
        yield pd.DataFrame(out, columns=["bi", "bj", "v"])


def _rest(frames):
    for frame in frames:
        out = []
        for bi, bj, v, x, y in zip(frame["bi"], frame["bj"], frame["v"], frame["x"], frame["y"]):
            n = int(len(x) ** 0.5)
            m = (np.zeros(n * n) if v is None else np.array(v)).reshape(n, n)
            out.append((bi, bj, (m - np.array(x).reshape(n, n) @ np.array(y).reshape(n, n).T).ravel()))
        yield pd.DataFrame(out, columns=["bi", "bj", "v"])


def _rounds(blocks: DataFrame, count: int) -> list[DataFrame] | None:
    from tideline.plans.scratch import written

    kind, out, left = "bi int, bj int, v array<double>", [], written(blocks, "chol")
    for k in range(count):
        top = written(left.filter((F.col("bi") == k) & (F.col("bj") == k)).mapInPandas(_factor, kind), "chol-top")
        if top.filter("v is null").count():
            return None
        out.append(top)
        if k == count - 1:
            break
        one = top.select(F.col("v").alias("top"))  # a row
        side = written(left.filter((F.col("bj") == k) & (F.col("bi") > k)).join(F.broadcast(one)).mapInPandas(_panel, kind), "chol-side")
        out.append(side)
        x, y = side.select("bi", F.col("v").alias("x")), side.select(F.col("bi").alias("bj"), F.col("v").alias("y"))
        pairs = x.join(y, F.col("bi") >= F.col("bj")) if k == count - 2 else x.join(y.withColumn("bi", F.explode(F.sequence("bj", F.lit(count - 1)))), "bi")
        pairs = pairs.select("bi", "bj", "x", "y")
        left = written(pairs.join(left.filter((F.col("bj") > k)), ["bi", "bj"], "left").select("bi", "bj", "v", "x", "y").mapInPandas(_rest, kind), "chol")
    return out


def cholesky(cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """a, b, value of the lower factor L (L L' = the matrix) of a symmetric pair table ``cells(a, b, value)``, and jitter.

    Assets go by name. The matrix lies in blocks of ``size`` assets; round k factors block (k, k), solves the
    blocks under it and takes their products off the rest, by joins on block numbers; no task holds more than a
    few blocks. Where a block isn't positive, the rounds start again with the next of ``JITTERS`` on the
    diagonal. Missing pairs count 0; an empty table gives no row.
    """
    from tideline.plans.scratch import written

    names = written(cells.select(F.col("a").alias("name")).distinct().withColumn("place", F.row_number().over(W.orderBy("name")) - 1), "chol-names")  # a row per asset
    count = -(-names.count() // size)
    for jitter in JITTERS:
        found = _rounds(_blocks(cells, names, size, jitter), count) if count else []
        if found is not None:
            break
    else:
        raise ValueError("the matrix isn't positive semidefinite within the largest jitter")
    if not found:
        return cells.select("a", "b", F.col("value").cast("double").alias("value"), F.lit(0.0).alias("jitter")).limit(0)
    all_ = found[0]
    for x in found[1:]:
        all_ = all_.unionByName(x)
    flat = all_.select("bi", "bj", F.posexplode("v").alias("at", "value")).select((F.col("bi") * size + F.floor(F.col("at") / size)).alias("pa"), (F.col("bj") * size + F.col("at") % size).alias("pb"), "value").filter("pa >= pb")
    i, j = (names.select(F.col("name").alias(c), F.col("place").alias(f"p{c}")) for c in "ab")
    return flat.join(i, "pa").join(j, "pb").select("a", "b", "value", F.lit(jitter).alias("jitter"))
