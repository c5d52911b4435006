"""Connected components of an edge table: forests per task, then stars until nothing changes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import dropped, written

#: Forests of at most so many edges are joined by one task; larger ones by rounds of shuffles.
ONE_TASK = 400_000
#: Edges that a task holds at once while it makes its forest.
HELD = 400_000


class Forest:
    """Least-id union-find over any ids."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, a: int) -> int:
        root, top = self.root, a
        while (up := root.get(top, top)) != top:
            top = up
        while a != top:
            root[a], a = top, root.get(a, a)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.root.setdefault(min(a, b), min(a, b))


def _forests(batches):
    """Stars (u, v) that connect what the task's edges connect, in chunks of HELD vertices."""
    own = Forest()

    def rows():
        ids = np.fromiter(own.root, np.int64, len(own.root))
        top = np.fromiter((own.find(x) for x in ids.tolist()), np.int64, len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[ids != top]), pa.array(top[ids != top])], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            own.join(a, b)
        if len(own.root) > HELD:
            yield rows()
            own = Forest()
    yield rows()


def _labels(batches):
    """All components in one task, for forests of ONE_TASK edges at most: (id, component)."""
    own = Forest()
    for batch in batches:
        for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            own.join(a, b)
    ids = np.fromiter(own.root, np.int64, len(own.root))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.fromiter((own.find(x) for x in ids.tolist()), np.int64, len(ids)))], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of ``edges(a long, b long)`` reaches, itself included.

    Every task first reduces its edges to a forest. A forest of at most ONE_TASK edges (counted) goes to
    a single task; a larger one to rounds of large-star / small-star: every vertex joins its larger
    neighbours to its least neighbour, then its smaller ones, until no edge changes. Each round is a
    partial aggregation and a join on the vertex, written to the shared folder; rounds go on until nothing
    changes (about the logarithm of the longest chain).
    """
    both = edges.filter("a is not null and b is not null and a != b").select("a", "b")
    forests = written(both.mapInArrow(_forests, "u long, v long"), "cc")
    if forests.count() <= ONE_TASK:
        out = written(forests.coalesce(1).mapInArrow(_labels, "id long, component long"), "cc")
        dropped(forests)
        return out
    now = written(forests.distinct(), "cc")
    dropped(forests)
    mark = _mark(now)
    while mark[0]:
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = written(small.filter("u != v").distinct(), "cc")
        dropped(now, large)
        now, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = written(stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "cc")
    dropped(now)
    return out


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the edges do: their number and a sum of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1)))).first())
