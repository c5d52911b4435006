"""Self-join of documents on the Jaccard similarity of their word shingles, heavy and light by size.

Small sets enumerate subsets of fixed sizes: two small sets are similar exactly if they share a subset
of the size that their similarity needs, so equal signatures are links without any check. Large sets are
looked up in inverted lists of their rarest shingles. A cost model sets the boundary between the two.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Words, dropped, mix64, slices, small as checked, written
from tideline.llm.graphs import components

#: Words of a shingle and the least similarity, in hundredths.
SHINGLE, PERCENT = 4, 85
#: A shingle that is in so many documents, counted where a task has it twice, goes to the end of the lists'
#: order (an order is right whatever it is; this one keeps lists short); at most so many do.
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Longer lists are joined by leaders and components instead of pair by pair.
LIST = 64
#: Entries of lists in one task.
LIST_ROWS = 2_500_000
#: Set sizes that the cost model tells apart (larger ones are large), and the cost of checking a candidate, in written rows.
SIZES, CHECK_COST = 64, 20.0
#: Stands for a null doc_id in keys.
_NO_ID = -(1 << 63)
#: Sets of a block that is compared at once (in small and large clusters), shingles of one, and rounds of
#: blocks dealt by chance.
BLOCK, LARGE_BLOCK, BLOCK_SHINGLES, ROUNDS = 128, 384, 2_000_000, 1
#: Sets that hang together by long lists are compared in blocks up to so many; larger ones list by list.
CLUSTER = 100_000
#: Buckets of the counts that bound how much two sets have in common.
SPREAD = 128
#: Component labels up to so many are broadcast; more are joined by shuffle.
LABELS = 200_000
#: Wanted documents up to so many are broadcast to fetch their texts; more are joined by shuffle.
WANTED_ROWS = 500_000


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Common shingles that sets of a and b shingles need."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of n enumerates: what it needs in common with each size in reach."""
    reach = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({needed(n, m, percent) for m in reach if m and needed(n, m, percent) <= min(n, m)})


def prefix_sizes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Shingles that a set of n looks up, and those under which it is listed for sets as large or larger."""
    return n - -(-percent * n // 100) + 1, n - needed(n, n, percent) + 1


def boundary(histogram: dict[int, int], partners: float, percent: int = PERCENT) -> int:
    """Largest size that enumerates: least written rows and checks over the histogram of set sizes.

    ``partners``: documents met in a list, on average.
    """
    best, at, subsets = math.inf, 0, 0.0
    lists = {n: c * prefix_sizes(n, percent)[0] * (1 + CHECK_COST * partners) for n, c in histogram.items()}
    for b in range(SIZES):
        subsets += histogram.get(b, 0) * sum(math.comb(b, s) for s in subset_sizes(b, percent)) if b else 0
        total = subsets + sum(x for n, x in lists.items() if n > b or n >= percent * (b + 1) / 100)
        if total < best:
            best, at = total, b
    return at


def shingle_sets(texts, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    words = Words(texts)
    h, first = words.hash, words.first
    roll = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        roll += mix64(h[j : len(h) - k + 1 + j] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
    roll = mix64(roll)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(roll[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            own = mix64(h[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)) * np.arange(3, 3 + 2 * (b - a), 2, dtype=np.uint64)
            out.append(mix64(own.sum(dtype=np.uint64)[None] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    x = mix64(mix64(s).sum(dtype=np.uint64, keepdims=True) + mix64(np.array([len(s)], np.uint64)))
    return int(x.view(np.int64)[0])


def _count(held: list[np.ndarray]) -> pa.RecordBatch:
    """Shingles that occur in two of these documents or more; all others are in one document per task."""
    s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(s)))
    keys = s[at[n > 1]].view(np.int64)
    no = pa.array(np.zeros(len(keys), bool))
    none = pa.nulls(len(keys), pa.int64())
    return pa.RecordBatch.from_arrays([no, none, none, pa.array(keys), pa.array(n[n > 1])], ["row", "doc_id", "text_key", "key", "n"])


def _measure(k: int):
    """Rows (true, doc_id, text_key, digest, set size), and (false, null, null, shingle, documents) of shingles that repeat in a task."""

    def run(batches):
        held, total, seen = [], 0, set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part["text"], k)
                names = [digest(s) if len(s) else None for s in sets]
                columns = [pa.array(np.ones(len(sets), bool)), part["doc_id"], part["text_key"], pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_key", "key", "n"])
                for name, s in zip(names, sets):
                    if name is not None and name not in seen:
                        seen.add(name)
                        held.append(s)
                        total += len(s)
                if total > 3_000_000:
                    yield _count(held)
                    held, total, seen = [], 0, set()
        yield _count(held)

    return run


def _post(frequent, small: int, k: int, percent: int):
    """Rows (kind, key, digest, n, at): signatures of small sets (kind 0), list entries (1, or 2 under a frequent shingle)."""

    def run(batches):
        late, seen = frequent.value, set()
        hint = np.zeros(1 << 20, bool)
        hint[(late & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[], [], [], [], []]
                for s in shingle_sets(part["text"], k):
                    n = len(s)
                    if not n or (name := digest(s)) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(name)
                    keys, kinds, at = [], [], []
                    if n <= small:
                        m = mix64(s)
                        for size in subset_sizes(n, percent):
                            pick = np.array(list(combinations(range(n), size)), np.int64)
                            keys.append(mix64(m[pick].sum(1, dtype=np.uint64) + np.uint64(size)))
                            kinds.append(np.zeros(len(pick), np.int8))
                            at.append(np.full(len(pick), size))
                    if n > small or 100 * n >= percent * (small + 1):
                        wide = prefix_sizes(n, percent)[0]
                        maybe = np.flatnonzero(hint[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
                        rare, common = s[:wide], s[:0]
                        if len(maybe):
                            is_late = np.zeros(n, bool)
                            spot = np.minimum(np.searchsorted(late, s[maybe]), len(late) - 1)
                            is_late[maybe] = late[spot] == s[maybe]
                            rare = s[~is_late][:wide]
                            common = s[is_late][: wide - len(rare)]
                        keys += [rare, common]
                        kinds += [np.full(len(rare), 1, np.int8), np.full(len(common), 2, np.int8)]
                        at.append(np.arange(len(rare) + len(common)))
                    count = sum(map(len, keys))
                    for column, x in zip(rows, (kinds, keys, [np.full(count, name, np.int64)], [np.full(count, n, np.int64)], at)):
                        column += x
                if rows[0]:
                    kind, key, name, n, at = (np.concatenate(x) for x in rows)
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), pa.array(name), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], ["kind", "key", "name", "n", "at"])

    return run


def _fits(n1, at1, n2, at2, percent: int):
    """If entries of two sets in one list can belong to a similar pair: sizes, what is left after them, reach."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    need = -(-percent * (n1 + n2) // (100 + percent))
    at_low = np.where(n1 <= n2, at1, at2)
    return (100 * low >= percent * high) & (np.minimum(n1 - at1, n2 - at2) >= need) & ((at_low <= low - (-(-2 * percent * low // (100 + percent)))) | (n1 == n2))


_FOUND = ["x", "y", "first", "key", "n", "at"]
_FOUND_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]


def _long(key, name, n, at) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(name), none, none.cast(pa.bool_()), pa.array(key), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], _FOUND)


def _in_lists(key, name, n, at, percent: int):
    """Candidates of whole lists; the entries of those over LIST."""
    order = np.lexsort((name, key))
    key, name, n, at = key[order], name[order], n[order].astype(np.int64), at[order].astype(np.int64)
    new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
    key, name, n, at = key[new], name[new], n[new], at[new]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.append(head, len(key)))
    out = []
    turn = np.arange(len(key)) - np.repeat(head, size)
    whole = np.repeat(size, size)
    for gap in range(1, min(int(size.max(initial=0)), LIST)):
        i = np.flatnonzero((turn + gap < whole) & (whole <= LIST))
        if not len(i):
            break
        i = i[_fits(n[i], at[i], n[i + gap], at[i + gap], percent)]
        out.append(np.stack([name[i], name[i + gap], turn[i] == 0]))
    if out:
        pairs = np.unique(np.concatenate(out, 1), axis=1)
        none = pa.nulls(pairs.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(bool)), none, none.cast(pa.int32()), none.cast(pa.int32())], _FOUND)
    long = np.flatnonzero(whole > LIST)
    if len(long):
        yield _long(key[long], name[long], n[long], at[long])


def _lists(percent: int, most: int = 400_000):
    """Candidates (x, y, first) from lists sorted by key; lists over LIST entries come back as entries.

    ``first``: the pair holds the least name of its list. Rows of a long list have y null, and key, n, at.
    A list that fills ``most`` entries by itself is long and goes out as it comes in, so memory is bounded.
    """

    def run(batches):
        held: list[list[np.ndarray]] = []
        passing = None  # the key of a list that is known to be long
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("key", "name", "n", "at")]
            if passing is not None:
                cut = int(np.searchsorted(now[0], passing, "right"))
                if cut:
                    yield _long(*(x[:cut] for x in now))
                    now = [x[cut:] for x in now]
            if not len(now[0]):
                continue
            held.append(now)
            if sum(len(h[0]) for h in held) >= most:
                whole = [np.concatenate([h[k] for h in held]) for k in range(4)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                if cut:
                    yield from _in_lists(*(x[:cut] for x in whole), percent)
                    held = [[x[cut:] for x in whole]]
                else:
                    passing, held = whole[0][-1], []
                    yield _long(*whole)
        if held:
            yield from _in_lists(*(np.concatenate([h[k] for h in held]) for k in range(4)), percent)
        yield pa.RecordBatch.from_arrays([pa.array([], k) for k in _FOUND_KINDS], _FOUND)

    return run


def _check(k: int, percent: int):
    """The pairs of texts that are similar, by their exact sets."""

    def run(batches):
        for batch in batches:
            out = []
            for part in slices(batch, "text_x", 1_000_000):
                a, b = shingle_sets(part["text_x"], k), shingle_sets(part["text_y"], k)
                for x, y, s, t in zip(part["x"].to_pylist(), part["y"].to_pylist(), a, b):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both) and digest(s) == x and digest(t) == y:
                        out.append((x, y))
            xs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(xs[:, 0]), pa.array(xs[:, 1])], ["a", "b"])

    return run


def _once(batches):
    """The first row of each name in a task."""
    seen = set()
    for batch in batches:
        fresh = [name not in seen and not seen.add(name) for name in batch["name"].to_pylist()]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _rows_of(names: DataFrame, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """(name, text) of a document of each set in ``names(name)``, mostly once each, and how many names there are.

    A document is met by its id and a hash of its text, so rows without doc_id or with a repeated one are too.
    """
    wanted = written(names.join(classes, "name").select("name", F.col("doc").alias("id"), "text_key"), "ngram-wanted")
    n = wanted.count()
    side = F.broadcast(wanted) if n <= WANTED_ROWS else wanted
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).join(side, ["id", "text_key"]).select("name", "text").mapInArrow(_once, "name long, text string"), n


def _single(table: DataFrame, n: int, label: str) -> DataFrame:
    """``table`` with a row for each of its n names (equal rows without doc_id may be there once a task)."""
    if table.count() == n:
        return table
    out = written(table.dropDuplicates(["name"]), label)
    dropped(table)
    return out


def _texts(names: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The text of one document of each set in ``names(name)``."""
    found, n = _rows_of(names, docs, classes)
    return _single(written(found, "ngram-texts"), n, "ngram-texts")


def _joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    return components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges))


def _compare(group: pa.Table, k: int, percent: int) -> pa.Table:
    """A forest of the similar pairs of a block: common shingles of all pairs by products of membership matrices."""
    names, sets = group["name"].to_numpy(), shingle_sets(group["text"], k)
    good = [digest(s) == x if len(s) else False for s, x in zip(sets, names.tolist())]
    names, sets = names[good], [s for s, g in zip(sets, good) if g]
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets):
        keys, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        row, shared = np.repeat(np.arange(len(sets)), size), count[back] > 1
        row, column = row[shared], column[back[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int((count > 1).sum()), 8_192):
            a, b = np.searchsorted(column, [low, low + 8_192])
            m = np.zeros((len(sets), 8_192), np.float32)
            m[row[a:b], column[a:b] - low] = 1
            both += m @ m.T
    hits = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    root, edges = list(range(len(sets))), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hits))):
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((i, j))
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(names[e[:, 0]], pa.int64()), "b": pa.array(names[e[:, 1]], pa.int64())})


def _blocks(members: DataFrame, comp: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Components after all sets of a cluster have met that are in different ones.

    Rounds of blocks dealt by chance join most of a cluster. What is outside its largest component then
    meets the whole cluster, block by block, so no pair of sets of two components is left out.
    """
    texts = None
    for turn in range(ROUNDS + 1):
        labelled = members.join(checked(comp, LABELS), F.col("name") == F.col("id"), "left").select("cluster", "name", "n", F.coalesce("component", "name").alias("c"))
        cells = labelled.groupBy("cluster", "c").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        state = cells.groupBy("cluster").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("k"), F.sum("n").alias("shingles"), F.count("*").alias("cells"))
        state = state.filter((F.col("cells") > 1) & (F.col("k") <= CLUSTER)).withColumn("blocks", F.greatest(F.ceil(F.col("k") / LARGE_BLOCK), F.least(F.lit(16), F.ceil(F.col("k") / BLOCK)), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
        active = written(labelled.join(state, "cluster").select("cluster", "name", "c", "main", "k", "most", "blocks"), "ngram-active")
        if not active.count():
            dropped(active, *([texts] if texts is not None else []))
            return comp
        if texts is None:
            texts = _texts(active.select("name"), docs, classes)
        block = F.pmod(F.xxhash64("name", F.lit(turn)), F.col("blocks")).cast("int")
        if turn < ROUNDS:
            dealt = active.select("cluster", block.alias("i"), F.lit(0).alias("j"), "name")
        else:
            few = F.ceil((F.col("k") - F.col("most")) * F.col("blocks") / F.col("k")).cast("int")  # blocks of outsiders
            out = active.filter("c != main").select("cluster", F.pmod(F.xxhash64("name", F.lit(turn)), few).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "name")
            every = active.select("cluster", F.explode(F.sequence(F.lit(0), few - 1)).alias("i"), block.alias("j"), "name")
            dealt = out.unionByName(every).distinct()
        edges = dealt.join(texts, "name").groupBy("cluster", "i", "j").applyInArrow(lambda group: _compare(group, k, percent), "a long, b long")
        edges = written(edges.distinct(), "ngram-edges")
        comp, before = _joined(comp, edges), comp
        dropped(active, edges, before)
    dropped(texts)
    return comp


def _spread(k: int):
    """(name, spread): how many shingles of each set fall into each of SPREAD buckets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                spread = [np.bincount((s >> np.uint64(17)).astype(np.int64) % SPREAD, minlength=SPREAD).clip(0, 65_535).astype(np.uint16).tobytes() for s in shingle_sets(part["text"], k)]
                yield pa.RecordBatch.from_arrays([part["name"], pa.array(spread, pa.binary())], ["name", "spread"])

    return run


def _close(percent: int):
    """Pairs that can be similar: sets have no more in common than the sum of their lesser bucket counts.

    Buckets over 65,535 count as unbounded, so no similar pair is lost.
    """

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, SPREAD).astype(np.int64) for c in ("spread_x", "spread_y"))
            full = (a == 65_535) | (b == 65_535)
            both = np.minimum(a, b).sum(1)
            good = full.any(1) | (100 * both >= percent * (a.sum(1) + b.sum(1) - both))
            yield pa.RecordBatch.from_arrays([batch["x"].filter(pa.array(good)), batch["y"].filter(pa.array(good))], ["x", "y"])

    return run


def _checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) of the pairs (x, y) of set names whose documents are similar."""
    ends = lambda p: p.select(F.col("x").alias("name")).unionByName(p.select(F.col("y").alias("name"))).distinct()
    found, n = _rows_of(ends(pairs), docs, classes)
    spread = _single(written(found.mapInArrow(_spread(k), "name long, spread binary"), "ngram-spread"), n, "ngram-spread")
    x, y = (spread.select(F.col("name").alias(c), F.col("spread").alias(f"spread_{c}")) for c in ("x", "y"))
    close = written(pairs.join(x, "x").join(y, "y").select("x", "y", "spread_x", "spread_y").mapInArrow(_close(percent), "x long, y long").distinct(), "ngram-close")
    dropped(spread)
    texts = _texts(ends(close), docs, classes)
    x, y = (texts.select(F.col("name").alias(c), F.col("text").alias(f"text_{c}")) for c in ("x", "y"))
    edges = written(close.join(x, "x").join(y, "y").select("x", "y", "text_x", "text_y").mapInArrow(_check(k, percent), "a long, b long"), "ngram-edges")
    dropped(texts, close)
    return edges


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    comp = checked(comp, LABELS)
    own = lambda end: comp.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    joined = pairs.join(own("x"), "x", "left").join(own("y"), "y", "left")
    return joined.filter(F.coalesce("cx", "x") != F.coalesce("cy", "y"))


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, group and text_key for every row of ``docs(doc_id, text, ...)``.

    Components are those of the links with a Jaccard similarity of percent/100 or more over the distinct
    ``shingle``-word shingles. Documents with equal sets are one vertex (a 64-bit digest). Each set is
    first checked with two leaders (least names) of its lists; of all other pairs only those that no chain
    of links joins yet. component_id is the least doc_id of the component, group the least digest in it
    (null without words), text_key a hash of the text.

    A null text or one without words has no shingle and its doc_id as component. Rows without doc_id are
    linked like others; their component_id is null where no document of theirs has a doc_id. Rows may
    repeat and doc_ids may be shared by different texts; an empty table gives no rows; texts are taken
    whole; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    measured = written(texts.mapInArrow(_measure(shingle), "row boolean, doc_id long, text_key long, key long, n long"), "ngram-measured")
    rows = measured.filter("row")
    counts = measured.filter("not row").groupBy("key").agg(F.sum("n").alias("n"))
    total = measured.filter("not row").agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, -(-total // MOST_FREQUENT))  # so there are MOST_FREQUENT at most
    late = np.sort(counts.filter(F.col("n") >= least).select("key").toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast(late)
    sizes = {r["n"]: r["c"] for r in rows.filter("n > 0").groupBy(F.least("n", F.lit(SIZES)).alias("n")).agg(F.count("*").alias("c")).collect()}
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    small = boundary(sizes, total / max(1, shingles), percent)
    known = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "text_key")
    classes = rows.filter("n > 0").groupBy(F.col("key").alias("name")).agg(F.min(known).alias("d"), F.count("*").alias("members"))
    classes = written(classes.select("name", "d.doc", "d.text_key", "d.none", "members"), "ngram-classes")

    posts = written(texts.mapInArrow(_post(frequent, small, shingle, percent), "kind byte, key long, name long, n int, at int"), "ngram-posts")
    entry = posts.filter("kind = 1").select("key", "name", "n", "at")
    parts = max(6, -(-posts.count() // LIST_ROWS))  # a pair is found once in each task that holds a shingle of it
    found = written(entry.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_lists(percent), "x long, y long, first boolean, key long, n int, at int"), "ngram-found")
    pairs = found.filter("y is not null").groupBy("x", "y").agg(F.max("first").alias("first"))
    long = written(posts.filter("kind = 2").select("key", "name", "n", "at").unionByName(found.filter("y is null").select("key", F.col("x").alias("name"), "n", "at")).distinct(), "ngram-long")

    # small sets: the smallest set with a signature is linked to all others of a size that the signature suffices for
    signs = posts.filter("kind = 0").select("key", "name", "n", F.col("at").alias("size")).distinct()
    heads = signs.groupBy("key", "size").agg(F.min(F.struct("n", "name")).alias("h"))
    enough = F.col("size") * (100 + percent) >= percent * (F.col("n") + F.col("h.n"))
    by_subset = signs.join(heads, ["key", "size"]).filter(enough & (F.col("name") != F.col("h.name"))).select(F.col("name").alias("a"), F.col("h.name").alias("b"))

    # every set is checked with two of its lists' leaders, then with what its components leave apart
    leaders = long.groupBy("key").agg(F.min_by(F.struct("name", "n", "at"), "name").alias("l"))
    led = long.join(leaders, "key")
    star = _possible(led, "l.", percent).select("name", F.col("l.name").alias("l"))
    clusters = components(led.select(F.col("name").alias("a"), F.col("l.name").alias("b")))
    led = pairs.filter("first").select(F.col("y").alias("name"), F.col("x").alias("l")).unionByName(star)
    led = led.groupBy("name").agg(F.array(F.min("l"), F.max("l")).alias("l")).select("name", F.explode(F.array_distinct("l")).alias("l"))
    firsts = written(led.select(F.least("name", "l").alias("x"), F.greatest("name", "l").alias("y")).distinct(), "ngram-pairs")
    checked_firsts = _checked(firsts, texts, classes, shingle, percent)
    comp = components(checked_firsts.unionByName(by_subset))
    members = written(long.groupBy("name").agg(F.max("n").alias("n")).join(clusters, F.col("name") == F.col("id")).select("name", "n", F.col("component").alias("cluster")), "ngram-members")
    dropped(checked_firsts, clusters)
    comp = _blocks(members, comp, texts, classes, shingle, percent)
    huge = members.groupBy("cluster").agg(F.count("*").alias("k")).filter(F.col("k") > CLUSTER)
    listed = long.join(members.join(huge, "cluster", "left_semi"), "name", "left_semi")
    crossing, mixed = _crossing(listed, comp, percent)
    rest = pairs.select("x", "y").unionByName(crossing)
    rest = written(_apart(rest, comp).select("x", "y").distinct().join(firsts, ["x", "y"], "left_anti"), "ngram-rest")
    dropped(posts, found, long, firsts, members, mixed)
    edges = _checked(rest, texts, classes, shingle, percent)
    comp, before = _joined(comp, edges), comp
    dropped(rest, edges, before)

    named = classes.join(checked(comp, LABELS), F.col("name") == F.col("id"), "left").withColumn("c", F.coalesce("component", "name"))
    least_doc = named.groupBy("c").agg(F.min(F.when(~F.col("none"), F.col("doc"))).alias("component_id"))
    lookup = written(named.filter("component is not null or members > 1").join(least_doc, "c").select("name", "component_id", F.col("c").alias("group")), "ngram-lookup")
    dropped(classes, comp)
    own = rows.select("doc_id", "text_key", "key", "n").join(lookup, F.col("key") == F.col("name"), "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("group", "key").alias("group"), "text_key")


def _possible(joined: DataFrame, other: str, percent: int) -> DataFrame:
    """Rows whose two entries (n, at, name and the same under ``other``) can belong to a similar pair."""
    n, m, at, to = F.col("n"), F.col(f"{other}n"), F.col("at"), F.col(f"{other}at")
    need = F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - 1e-9)
    return joined.filter((F.col("name") != F.col(f"{other}name")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - at, m - to) >= need))


def _crossing(long: DataFrame, comp: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs within long lists whose ends are in different components, one end outside the list's largest."""
    labelled = long.join(checked(comp, LABELS), F.col("name") == F.col("id"), "left").select("key", "name", "n", "at", F.coalesce("component", "name").alias("c"))
    cells = labelled.groupBy("key", "c").agg(F.count("*").alias("k"))
    largest = cells.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("cells")).filter("cells > 1").select("key", "main")
    mixed = written(labelled.join(largest, "key"), "ngram-mixed")
    outside = mixed.filter("c != main").select("key", F.struct("name", "n", "at", "c").alias("o"))
    met = mixed.join(outside, "key").filter((F.col("c") != F.col("o.c")) & ((F.col("c") == F.col("main")) | (F.col("name") < F.col("o.name"))))
    return _possible(met, "o.", percent).select(F.least("name", "o.name").alias("x"), F.greatest("name", "o.name").alias("y")), mixed
