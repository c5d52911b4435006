"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.llm.common import byte_words, slices, trimmed, written

TOP = 10
#: (item, term) rows of the items that one round ranks: their terms go to every task. More items take more rounds.
ENTRIES_AT_ONCE = 200_000
#: Bytes of the presence bitmaps of a block of documents, and its most documents.
BITMAP_BYTES, BLOCK = 1 << 25, 1 << 14
#: Masks that are evaluated at once.
MASKS = 256

#: Bytes of terms: digits, ASCII letters and all of other characters.
SOLID = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, first, _ = byte_words(batch["text"], SOLID)
        ids = batch["item_id"].take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
        yield pa.RecordBatch.from_arrays([ids, words.cast(pa.string())], ["item_id", "term"])


def _matches(terms: pa.Array):
    """doc_id, n, and which of ``terms`` a document holds how often; documents without a term give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                words, first, _ = byte_words(batch["text"], SOLID)
                coded = words.dictionary_encode()
                known = pc.index_in(coded.dictionary.cast(pa.string()), value_set=terms).fill_null(-1).to_numpy()
                term = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                n = np.diff(first)
                row = np.repeat(np.arange(batch.num_rows), n)[term >= 0]
                key, tf = np.unique(row * max(1, len(terms)) + term[term >= 0], return_counts=True)
                row, term = key // max(1, len(terms)), key % max(1, len(terms))
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(cut), pa.array(values, kind))  # noqa: B023, E731
                out = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), lists(term, pa.int32()), lists(tf, pa.int64())], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return run


class Best:
    """The highest (score, least id) rows of one item so far."""

    def __init__(self, top: int) -> None:
        self.top, self.score, self.id = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score > 0
        score, ids = np.append(self.score, score[good]), np.append(self.id, ids[good])
        order = np.lexsort((ids, -score))[: self.top]
        self.score, self.id = score[order], ids[order]

    @property
    def least(self) -> int:
        """The score under which nothing enters any more."""
        return int(self.score[-1]) if len(self.score) == self.top else 0


def rank_block(best: Best, wanted: np.ndarray, bits: np.ndarray, where: np.ndarray, docs: np.ndarray, gain: np.ndarray, most: np.ndarray, ids: np.ndarray) -> int:
    """Adds a block's documents to ``best`` of an item with terms ``wanted``; returns how many were scored.

    ``bits`` are the terms' presence bitmaps over the block; ``docs`` and ``gain`` the postings of term t at
    ``where[t] : where[t + 1]``; ``most`` a term's largest gain. Terms whose largest gains together stay under
    the least score can't lift a document alone: documents with none of the others are left out by OR of the
    others' bitmaps. The rest are grouped by their mask of terms; masks go by descending sum of largest
    gains, until that sum falls under the least score. Equal scores are still evaluated, as ids decide ties.
    """
    wanted = wanted[most[wanted] > 0]
    wanted = wanted[np.argsort(most[wanted], kind="stable")]
    low = int(np.searchsorted(np.cumsum(most[wanted]), max(best.least, 1)))
    if low == len(wanted):
        return 0
    near = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[wanted[low:]], axis=0), count=len(ids)))
    held = np.unpackbits(bits[wanted], axis=1, count=len(ids))[:, near]
    packed = np.packbits(held, axis=0).T
    wide = np.zeros((len(near), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    group = np.zeros(len(near), np.int64)
    for word in wide.view(np.uint64).T:  # masks of any number of terms
        values, code = np.unique(word, return_inverse=True)
        group = np.unique(group * len(values) + code, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[order], np.arange(group.max() + 2)) if len(group) else np.zeros(1, np.int64)
    bound = most[wanted] @ held[:, order[begin[:-1]]].astype(np.int64)
    seen = 0
    by = np.argsort(-bound, kind="stable")
    for k in range(0, len(by), MASKS):
        part = by[k : k + MASKS]
        part = part[bound[part] >= max(best.least, 1)]
        if not len(part):
            break
        some = np.sort(near[np.concatenate([order[begin[g] : begin[g + 1]] for g in part])])
        score = np.zeros(len(some), np.int64)
        for t in wanted:
            own = docs[where[t] : where[t + 1]]
            at = np.minimum(np.searchsorted(own, some), len(own) - 1)
            score += np.where(own[at] == some, gain[where[t] + at], 0)
        best.add(score, ids[some])
        seen += len(some)
    return seen


_LAST = np.iinfo(np.int64).max  # stands for a null id: after all others


def _ranked(items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, top: int):
    block = max(1024, min(BLOCK, BITMAP_BYTES * 8 // max(1, len(weight))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]

        def rank(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = table["doc_id"].fill_null(_LAST).to_numpy()
            lists = table["terms"].combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy().astype(np.int64), table["tfs"].combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), size)
            lengths, code = np.unique(table["n"].to_numpy(), return_inverse=True)
            m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64)[code]
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            order = np.argsort(term, kind="stable")
            term, doc, gain = term[order], doc[order], gain[order]
            where = np.searchsorted(term, np.arange(len(weight) + 1))
            most = np.zeros(len(weight), np.int64)
            np.maximum.at(most, term, gain)
            bits = np.zeros((len(weight), -(-len(ids) // 8)), np.uint8)
            np.bitwise_or.at(bits, (term, doc >> 3), (128 >> (doc & 7)).astype(np.uint8))
            for b, (_, wanted) in zip(best, items):
                rank_block(b, wanted, bits, where, doc, gain, most, ids)

        parts, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if rows + part.num_rows > block:
                    rank(parts)
                    parts, rows = [], 0
                parts.append(part)
                rows += part.num_rows
        if parts:
            rank(parts)
        item = [i for (i, _), b in zip(items, best) for _ in b.score]
        doc = np.concatenate([b.id for b in best]) if best else np.zeros(0, np.int64)
        score = np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, mask=doc == _LAST), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])
        trimmed()

    return run


def rank_documents(docs: DataFrame, bench: DataFrame, top: int = TOP, entries_at_once: int = ENTRIES_AT_ONCE) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest documents of each item of ``bench(item_id, text)``.

    Terms are runs of ASCII letters and digits and other characters, A-Z lower-cased. A term weighs
    floor(1000 ln((2N+2)/(2df+1))); a document's score sums weight x (10^9 tf div (1000 tf + 8 m)) over the
    item's terms, m = 10 + (90 n N) div L, in whole numbers. One pass over all documents counts the items'
    terms and writes which document holds which how often; a second one ranks blocks of them (``rank_block``)
    and passes on the best of each task; the best of all tasks are the result. Items go in rounds of about
    ``entries_at_once`` terms, so what tasks get is bounded; an item's own terms always go together.

    Null or empty texts have no terms: such items give no row, such documents count nowhere. Rows with one
    item_id are one item. Null doc_ids come last among equal scores; repeated documents are ranked each.
    Empty tables give no row. Other columns aren't read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term string").distinct()
    entries = written(rows, "search-items")
    rounds = max(1, -(-entries.count() // entries_at_once))
    found = None
    for k in range(rounds):
        mine = entries.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).toPandas()  # a round's entries
        terms = sorted(mine["term"].unique().tolist())
        turn = {t: i for i, t in enumerate(terms)}
        items = [(None if i != i else int(i), np.array([turn[t] for t in g["term"]], np.int64)) for i, g in mine.groupby("item_id", dropna=False, sort=True)]
        matched = written(texts.mapInArrow(_matches(pa.array(terms, pa.string())), "doc_id long, n long, terms array<int>, tfs array<long>"), "search-matches")
        n_docs, n_terms = matched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(terms), np.int64)
        for t, df in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the round
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        mine = matched.mapInArrow(_ranked(items, weight, n_docs, max(1, n_terms), top), "item_id long, doc_id long, score long")
        found = mine if found is None else found.unionByName(mine)
    best = written(found, "search-best")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
