"""Near-duplicate embeddings: a navigable small-world graph per shard, exact cosines, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import dropped, written
from tideline.llm.graphs import Forest, components

COSINE = 0.95
#: Vectors of a shard and of a block of queries; least number of shards.
SHARD_ROWS, QUERY_ROWS, LEAST_SHARDS = 32_768, 65_536, 6
#: Links of a node on the ground layer (half above), beams of building and of the first search.
DEGREE, BUILD_BEAM, BEAM = 24, 40, 32
#: Vectors of an audit, and the share of their links and of planted neighbours that the beam must find.
AUDIT, RECALL = 64, 0.98
_LOCKSTEP = 256


class SmallWorld:
    """Hierarchical navigable small-world graph over unit float32 vectors, searched in lock-step batches.

    Layers are built from the sparsest down; on each, batches of nodes search the graph so far from where
    the layer above leads, link to a diverse choice of what they find (and of their own batch), and are
    linked back with the same choice.
    """

    def __init__(self, x: np.ndarray, seed: int = 1) -> None:
        self.x = x
        rng = np.random.Generator(np.random.PCG64(seed))
        level = np.floor(-np.log(rng.random(len(x))) / np.log(DEGREE)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes of the layer, links (node numbers, -1: none)
        for l in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= l)
            if len(nodes):
                links = np.full((len(x), DEGREE if l == 0 else DEGREE // 2), -1, np.int32)
                self.layers.append((nodes, links))
                self._grow(nodes, links)

    def _grow(self, nodes: np.ndarray, links: np.ndarray) -> None:
        done = 0
        while done < len(nodes):
            batch = nodes[done : done + max(32, min(_LOCKSTEP, done))]
            near = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(near, -2.0)
            keep = min(len(batch) - 1, DEGREE)
            own = np.argsort(-near, axis=1)[:, :keep]
            ids, sims = batch[own], np.take_along_axis(near, own, 1)
            if done:
                enter = self._descend(self.x[batch], len(self.layers) - 1)
                enter = np.where(np.isin(enter, nodes[:done]), enter, nodes[0])[:, None]
                found, score = self._beam(links, self.x[batch], enter, BUILD_BEAM)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, score], 1)
            chosen = self._diverse(ids, sims, links.shape[1])
            links[batch] = chosen
            self._link_back(links, batch, chosen)
            done += len(batch)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates, near ones first, none nearer to a chosen one than to the row."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        x = self.x[np.maximum(ids, 0)]
        cross = x @ x.transpose(0, 2, 1)
        valid, chosen = (ids >= 0) & (sims > -1.5), np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            rival = np.where(chosen, cross[:, j, :], -2.0).max(1)
            chosen[:, j] = valid[:, j] & (rival < sims[:, j]) & (chosen.sum(1) < most)
        spare = valid & ~chosen  # fill up with the nearest of the rest
        rank = np.where(chosen, 0, np.where(spare, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def _link_back(self, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        a, b = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        a, b = a[chosen.ravel() >= 0], b[chosen.ravel() >= 0]
        if not len(a):
            return
        order = np.lexsort((-np.einsum("nd,nd->n", self.x[a], self.x[b]), a))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        turn = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
        near = turn < links.shape[1]
        nodes = a[head]
        fresh = np.full((len(nodes), links.shape[1]), -1, np.int64)
        fresh[np.searchsorted(nodes, a[near]), turn[near]] = b[near]
        fresh[(fresh[:, :, None] == links[nodes][:, None, :]).any(2)] = -1
        ids = np.concatenate([links[nodes], fresh], 1)
        sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", self.x[np.maximum(ids, 0)], self.x[nodes]), -2.0)
        links[nodes] = self._diverse(ids, sims, links.shape[1])

    def _descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        enter = np.full((len(q), 1), self.layers[0][0][0])
        for nodes, links in self.layers[:layers]:
            enter = self._beam(links, q, enter, 4)[0][:, :1]
        return enter[:, 0]

    def _beam(self, links: np.ndarray, q: np.ndarray, enter: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes that a greedy search with such a beam meets, best first (-1: none)."""
        n = len(q)
        ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -2.0, np.float32)
        ids[:, :1], sims[:, :1] = enter[:, :1], np.einsum("nd,nd->n", self.x[enter[:, 0]], q)[:, None]
        opened = np.zeros((n, width), bool)
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), enter[:, 0]] = True
        live = np.arange(n)
        while len(live):
            waiting = (ids[live] >= 0) & ~opened[live]
            live, waiting = live[waiting.any(1)], waiting[waiting.any(1)]
            if not len(live):
                break
            pick = np.argsort(~waiting, axis=1, kind="stable")[:, :4]  # the best not yet opened
            real = np.take_along_axis(waiting, pick, 1)
            opened[live[:, None], pick] |= real
            nodes = np.where(real, ids[live[:, None], pick], -1)
            near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            good = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            row, column = np.nonzero(good)
            met = near[row, column]
            seen[live[row], met] = True
            score = np.full(near.shape, -2.0, np.float32)
            score[row, column] = np.einsum("nd,nd->n", self.x[met], q[live[row]])
            all_ids, all_sims = np.concatenate([ids[live], np.where(good, near, -1)], 1), np.concatenate([sims[live], score], 1)
            all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live], opened[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_open, top, 1)
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(self.layers[-1][1], q, self._descend(q, len(self.layers) - 1)[:, None], width)


    def saved(self) -> tuple[list[bytes], list[bytes]]:
        """Nodes and links of all layers, the sparsest first."""
        return [nodes.astype(np.int64).tobytes() for nodes, _ in self.layers], [links.tobytes() for _, links in self.layers]

    @classmethod
    def loaded(cls, x: np.ndarray, nodes: list[bytes], links: list[bytes]) -> SmallWorld:
        """The graph over ``x`` that ``saved`` wrote."""
        out = cls.__new__(cls)
        out.x = x
        out.layers = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int32).reshape(len(x), -1)) for a, b in zip(nodes, links)]
        return out

    def linked(self, q: np.ndarray, width: int, least: float) -> list[np.ndarray]:
        """Nodes of about ``least`` or more for each query; a beam is doubled while its last node is still one.

        A beam of a quarter of the graph would cost more than a scan, so a scan ends the doubling.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        left = np.arange(len(q))
        while len(left):
            if width * 4 >= len(self.x):
                for k in left.tolist():
                    out[k] = np.flatnonzero(self.x @ q[k] >= least - 1e-4)
                break
            found, sims = self.search(q[left], width)
            full = sims[:, -1] >= least - 1e-4
            for k in np.flatnonzero(~full).tolist():
                out[left[k]] = found[k][sims[k] >= least - 1e-4]
            left, width = left[full], width * 2
        return out


def audited_beam(index: SmallWorld, q: np.ndarray, least: float) -> tuple[int, int, int]:
    """(beam, links found, links there): doubles the beam until audits find RECALL of what brute force finds.

    An audit asks for sampled queries, and for sampled vectors of the shard moved to a cosine just over
    ``least``, so that there are links to be found in any shard. Each probe is searched as queries are,
    with a beam that widens past its last link.
    """
    rng = np.random.Generator(np.random.PCG64(3))
    seeds = index.x[np.linspace(0, len(index.x) - 1, min(AUDIT, len(index.x))).astype(int)]
    noise = rng.standard_normal(seeds.shape).astype(np.float32)
    noise -= np.einsum("nd,nd->n", noise, seeds)[:, None] * seeds
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
    near = min(1.0, least + 0.005)
    planted = near * seeds + np.sqrt(1 - near * near) * noise
    probe = np.concatenate([q[np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)], planted.astype(np.float32)])
    truth = [np.flatnonzero(row >= least) for row in probe @ index.x.T]
    total, width = sum(map(len, truth)), BEAM
    while True:
        hit = sum(int(np.isin(close, got).sum()) for close, got in zip(truth, index.linked(probe, width, least)))
        if hit >= RECALL * total or width * 4 >= len(index.x):
            return width, hit, total
        width *= 2


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / (np.linalg.norm(x / top, axis=1, keepdims=True) * top)


_GRAPH = "dim int, shard int, names binary, members binary, vectors binary, nodes array<binary>, links array<binary>"


def _build(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
    """The graph of a shard, as one row."""
    shard = shard.sort_values("name")
    x = np.stack(shard["embedding"].to_numpy()).astype(np.float64)
    nodes, links = SmallWorld(_unit(x).astype(np.float32)).saved()
    whole = [shard[c].to_numpy().astype(np.int64).tobytes() for c in ("name", "members")]
    return pd.DataFrame([[int(key[0]), int(key[1]), *whole, x.tobytes(), nodes, links]], columns=[f.split()[0] for f in _GRAPH.split(", ")])


_FOUND = "vec long, other long, n long, hit long, total long"


def _search(least: float):
    """One block of queries against the graph of one shard: per query its links' weight, a forest of the links, and the audit."""

    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split()[0] for f in _FOUND.split(", ")]
        if not len(graph) or not len(queries):
            return pd.DataFrame(np.zeros((0, 5), np.int64), columns=columns)
        own = graph.iloc[0]
        ids, weight = np.frombuffer(own["names"], np.int64), np.frombuffer(own["members"], np.int64)
        wide = _unit(np.frombuffer(own["vectors"], np.float64).reshape(len(ids), -1))
        q, names = _unit(np.stack(queries["embedding"].to_numpy()).astype(np.float64)), queries["name"].to_numpy()
        index = SmallWorld.loaded(wide.astype(np.float32), list(own["nodes"]), list(own["links"]))
        narrow = q.astype(np.float32)
        beam, hit, total = audited_beam(index, narrow, least)
        forest, rows = Forest(), [(0, 0, -1, hit, total)]
        for at in range(0, len(q), _LOCKSTEP):
            for k, near in enumerate(index.linked(narrow[at : at + _LOCKSTEP], beam, least), at):
                name = int(names[k])
                near = near[(wide[near] @ q[k] >= least) & (ids[near] != name)]
                rows.append((name, name, int(weight[near].sum()), 0, 0))
                for b in ids[near].tolist():
                    if forest.find(name) != forest.find(b):
                        forest.join(name, b)
                        rows.append((name, b, 0, 0, 0))
        return pd.DataFrame(np.array(rows, np.int64), columns=columns)

    return run


def near_embeddings(rows: DataFrame, least: float = COSINE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall for every row of ``rows(vec_id, embedding, ...)``.

    Equal vectors form a class first (known by a 64-bit hash); each class is in the small-world graph of one
    shard. A shard's graph is built once and written; then blocks of queries are searched in every shard.
    Beams widen until audits against brute force pass and past the last link of every query; cosines are
    checked in double precision. audit_recall is the share of the audits' links that the chosen beams found.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors of
    different lengths don't link. Rows without vec_id link like others; they are never kept where a row with
    an id is in their component, and component_id is null where none is. Repeated rows of one vec_id link
    with each other as rows do. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    base = rows.select("vec_id", "embedding", F.coalesce(good, F.lit(False)).alias("good")).withColumn("name", F.when(F.col("good"), F.xxhash64("embedding")))
    classes = base.filter("good").groupBy("name").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("members"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("dim", F.size("embedding")), "near-classes")
    n = classes.count()
    shards, blocks = max(least_shards, -(-n // shard_rows)), max(least_shards, -(-n // query_rows))
    place = lambda salt, k: F.pmod(F.xxhash64("name", F.lit(salt)), F.lit(k)).cast("int")
    kept = classes.select("name", "members", "embedding", "dim")
    graphs = written(kept.withColumn("shard", place(1, shards)).groupBy("dim", "shard").applyInPandas(_build, _GRAPH), "near-graphs")
    graph_side = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    query_side = kept.withColumn("block", place(2, blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ("dim", "shard", "block")
    found = written(graph_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInPandas(_search(least), _FOUND), "near-found")
    audit = found.agg(F.sum("hit").alias("hit"), F.sum("total").alias("total")).first()
    recall = float(audit["hit"]) / audit["total"] if audit["total"] else 1.0
    comp = components(found.filter("vec != other").select(F.col("vec").alias("a"), F.col("other").alias("b")))
    links = found.filter("n >= 0").groupBy("vec").agg(F.sum("n").alias("n"))
    table = classes.join(links, F.col("name") == F.col("vec"), "left").join(comp, F.col("name") == F.col("id"), "left")
    table = table.select("name", "least_id", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "name").alias("group"))
    table = written(table, "near-links")
    dropped(classes, graphs, found, comp)
    named = written(table.join(table.groupBy("group").agg(F.min("least_id").alias("component")), "group").select("name", "n_links", "component"), "near-table")
    dropped(table)
    joined = base.select("vec_id", "name").join(named, "name", "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.col("component").isNull()).alias("kept"), F.lit(recall).alias("audit_recall"),
    )
