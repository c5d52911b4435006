"""Phrase collocations: pairs of frequency-ranked word ids counted in tiles, and pairs of frequent pairs again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.llm.common import byte_words, dropped, trimmed, written

LEAST, TOP = 10, 2000
#: A phrase goes where a longer one holds it and occurs in so many hundredths of its places.
INSIDE = 50
#: Bytes of text that are counted together, and word occurrences of a part of all tiles.
CHUNK, PART_WORDS = 8_000_000, 1_000_000
#: Chunks whose counts meet in one task; more are summed up over several rounds.
FAN_IN = 256
#: Widest side of a tile; tiles with an entry for every so many cells are counted densely.
WIDTH, SPARSE = 1024, 8

#: Bytes of words, and bytes that end a piece.
SOLID = np.array([b not in (9, 32) and b not in b".,;:!?\n\x0b\x0c\r" for b in range(256)])
APART = np.array([b in b".,;:!?\n\x0b\x0c\r" for b in range(256)])

_CHUNKS = "chunk long, lang string, words array<string>, n array<long>, codes binary"
_TILES = "part int, turn int, lang string, pair binary, third binary, n binary"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk of texts and language: its words, their counts, and its text as places in that list, -1 between pieces."""
    import pyarrow.compute as pc

    task, turn = TaskContext.get().partitionId(), 0
    kinds = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("codes", pa.binary())])

    def rows(parts: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        out = []
        for lang in table["lang"].unique():
            words, first, pieces = byte_words(table.filter(pc.equal(table["lang"], lang))["text"], SOLID, APART)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int32)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            new = np.flatnonzero((row[1:] != row[:-1]) | (pieces[1:] != pieces[:-1])) + 1
            out.append((chunk, lang.as_py(), coded.dictionary.to_pylist(), np.bincount(code, minlength=len(coded.dictionary)).tolist(), np.insert(code, new, -1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)] if out else [pa.array([], f.type) for f in kinds], schema=kinds)

    parts, total = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            take = max(int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK - total, side="right")), 0 if parts else 1)
            if take:
                parts.append(batch.slice(at, take))
                total += int(sizes[at : at + take].sum())
                at += take
            if at < batch.num_rows or total >= CHUNK:
                yield rows(parts, task << 32 | turn)
                parts, total, turn = [], 0, turn + 1
    if parts:
        yield rows(parts, task << 32 | turn)
    trimmed()


def edges(size: int) -> np.ndarray:
    """First ids of the tiles' sides: an eighth of the rank wide, as frequent words weigh more, up to ``WIDTH``."""
    out, at = [], 0
    while at < size or not out:
        out.append(at)
        at += min(WIDTH, max(1, at // 8))
    return np.array(out, np.int64)


def count_tiles(row: np.ndarray, col: np.ndarray, n: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, sum of n) of equal pairs: tiles between the edges ``rows`` and ``cols`` with enough entries by
    direct addresses (one bincount over the tile's cells), all other entries as one sorted list.
    """
    if not len(row):
        return row, col, n
    r, c = np.searchsorted(rows, row, "right") - 1, np.searchsorted(cols, col, "right") - 1
    tile = r * len(cols) + c
    order = np.argsort(tile, kind="stable")
    row, col, n, tile = row[order], col[order], n[order], tile[order]
    begin = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    size = np.diff(np.append(begin, len(tile)))
    wide = lambda at, all_: np.diff(np.append(all_, all_[-1] + WIDTH))[at]
    r, c = tile[begin] // len(cols), tile[begin] % len(cols)
    dense = size * SPARSE >= wide(r, rows) * wide(c, cols)
    out = []
    for k in np.flatnonzero(dense):
        own, width, top, left = slice(begin[k], begin[k] + size[k]), int(wide(c[k], cols)), rows[r[k]], cols[c[k]]
        total = np.bincount((row[own] - top) * width + (col[own] - left), weights=n[own])  # exact below 2 ** 53
        cell = np.flatnonzero(total)
        out.append((cell // width + top, cell % width + left, total[cell].astype(np.int64)))
    rest = np.repeat(~dense, size)
    row, col, n = row[rest], col[rest], n[rest]
    if len(row):
        order = np.lexsort((col, row))
        row, col, n = row[order], col[order], n[order]
        begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])))
        out.append((row[begin], col[begin], np.add.reduceat(n, begin)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = pa.schema([("part", pa.int32()), ("turn", pa.int32()), ("lang", pa.string()), ("pair", pa.binary()), ("third", pa.binary()), ("n", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kinds)] if found else [pa.array([], f.type) for f in kinds], schema=kinds)


def _tiled(size: int, parts: int, turns: int):
    """Of each chunk the runs of three ids (the third 0 where a piece ends), counted, by parts of all tiles."""
    side = edges(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, places, ids, codes in zip(*(batch[c] for c in ("chunk", "lang", "places", "ids", "codes"))):
                code = np.frombuffer(codes.as_buffer(), np.int32)
                known = np.full(int(code.max(initial=0)) + 2, -1, np.int64)  # the last one is for breaks
                known[places.values.to_numpy()] = ids.values.to_numpy()
                seq = np.append(known[code], [-1, -1])
                i, j, k = seq[:-2], seq[1:-1], seq[2:] + 1
                good = (i >= 0) & (j >= 0)
                pair, k = i[good] * size + j[good], k[good]
                order = np.lexsort((k, pair))
                pair, k = pair[order], k[order]
                begin = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (k[1:] != k[:-1]))) if len(pair) else np.zeros(0, np.int64)
                n = np.diff(np.append(begin, len(pair)))
                pair, k = pair[begin], k[begin]
                tile = (np.searchsorted(side, pair // size, "right") - 1) * len(side) + np.searchsorted(side, pair % size, "right") - 1
                part = (tile.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in np.flatnonzero(np.diff(cut)):
                    own = order[cut[p] : cut[p + 1]]
                    out.append((int(p), (chunk.as_py() * 2654435761 >> 16) % turns, lang.as_py(), pair[own].tobytes(), k[own].tobytes(), n[own].tobytes()))
                yield _rows(out)
        trimmed()

    return run


def _sums(pair: np.ndarray, third: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((third, pair))
    pair, third, n = pair[order], third[order], n[order]
    begin = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])))
    return pair[begin], third[begin], np.add.reduceat(n, begin)


def _each_group(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]):
    """(key, pair, third, n) of runs of rows with one key; what is held is summed up as it grows, so it stays near the group's distinct entries."""
    now, held, rows, limit = None, [], 0, 4_000_000
    for batch in batches:
        for *mine, pair, third, n in zip(*(batch[c] for c in (*key, "pair", "third", "n"))):
            mine = tuple(x.as_py() for x in mine)
            if mine != now:
                if held:
                    yield now, *(np.concatenate(x) for x in zip(*held))
                now, held, rows, limit = mine, [], 0, 4_000_000
            held.append(tuple(np.frombuffer(x.as_buffer(), np.int64) for x in (pair, third, n)))
            rows += len(held[-1][0])
            if rows > limit:
                held = [_sums(*(np.concatenate(x) for x in zip(*held)))]
                rows = len(held[0][0])
                limit = max(limit, 2 * rows)
    if held:
        yield now, *(np.concatenate(x) for x in zip(*held))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (part, turn, lang), *entries in _each_group(batches, ("part", "turn", "lang")):
        yield _rows([(part, turn, lang, *(x.tobytes() for x in _sums(*entries)))])
    trimmed()


def _frequent(size: int, least: int):
    """Pairs and triples with ``least`` occurrences: pairs in tiles, then frequent pairs, ranked anew, with the third word in tiles."""
    side, after = edges(size), edges(size + 1)
    kinds = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("k", pa.int64()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang), pair, third, n in _each_group(batches, ("part", "lang")):
            i, j, a = count_tiles(pair // size, pair % size, n, side, side)
            i, j, a = i[a >= least], j[a >= least], a[a >= least]
            rank = np.argsort(-a, kind="stable")
            i, j, a = i[rank], j[rank], a[rank]
            code = i * size + j
            by = np.argsort(code)
            at = np.minimum(np.searchsorted(code[by], pair), max(len(code) - 1, 0))
            good = (third > 0) & (code[by][at] == pair) if len(code) else np.zeros(len(pair), bool)
            r, k, b = count_tiles(by[at[good]], third[good] - 1, n[good], np.arange(0, max(len(code), 1), WIDTH), after)
            r, k, b = r[b >= least], k[b >= least], b[b >= least]
            all_ = [np.concatenate(x) for x in ((i, i[r]), (j, j[r]), (np.full(len(i), -1), k), (a, b))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(all_[0]), pa.string()), *(pa.array(x, pa.int64()) for x in all_)], schema=kinds)
        trimmed()

    return run


def _by_frequency(counts: DataFrame) -> DataFrame:
    """``counts(lang, word, f)`` with id: the rank by falling f in each language, from 0. Ranks are dealt in groups of
    words with one f and one of 64 hash values, so no task sorts a whole language.
    """
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)).cast("int"))
    before = W.partitionBy("lang").orderBy(F.desc("f"), "salt").rowsBetween(W.unboundedPreceding, -1)
    heads = salted.groupBy("lang", "f", "salt").agg(F.count("*").alias("m")).select("lang", "f", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("head"))
    place = F.row_number().over(W.partitionBy("lang", "f", "salt").orderBy("word")) - 1
    return salted.withColumn("place", place).join(heads, ["lang", "f", "salt"]).select("lang", "word", "f", (F.col("head") + F.col("place")).alias("id"))


def _score(a: str, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)), exact: products of whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(F.col(a)) * whole(F.col(a)) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 and 3 words of ``docs(lang, text)``.

    Texts (A-Z lower-cased) are split into pieces at ``.,;:!?`` and line ends, pieces at blanks and tabs. n
    counts all words, a, l and r a phrase and its parts within pieces. Phrases occur ``least`` times or more;
    score is floor(10^6 a^2 / (l r)) at the cut with the least score (the first of equal ones). A pair goes
    where a candidate of three words holds it with 100 f >= ``inside`` a.

    Words are counted once over all documents; those with ``least`` occurrences (no other can stand in a
    candidate) are ranked by frequency, chunks of text are rewritten in ranks through their own words'
    list, and their runs of three ids move, counted, to parts made of tiles of word pairs. A part counts its
    pairs in tiles (``count_tiles``), ranks the frequent ones anew, and counts those with a third word in
    tiles again. Every count is over all documents; a tile with many chunks is summed up over rounds.

    Null languages are ``und``; null and empty texts have no words; repeated rows count each; texts of any
    length are read whole; an empty table gives no row; other columns aren't read.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = written(texts.mapInArrow(_coded, _CHUNKS), "phrase-chunks")
    listed = chunks.select("chunk", "lang", F.explode(F.arrays_zip("words", "n")).alias("x")).select("chunk", "lang", F.col("x.words").alias("word"), F.col("x.n").alias("f"))
    counts = written(listed.groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    vocab = written(_by_frequency(counts.filter(F.col("f") >= least)), "phrase-vocab")
    size, words = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    parts = max(1, -(-words // PART_WORDS))
    turns = chunks.select("chunk").distinct().count()
    places = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word")).join(vocab.select("lang", "word", "id"), ["lang", "word"])
    ids = places.groupBy("chunk", "lang").agg(F.collect_list(F.struct("place", "id")).alias("x")).select("chunk", "lang", F.col("x.place").alias("places"), F.col("x.id").alias("ids"))
    ready = chunks.select("chunk", "lang", "codes").join(ids, ["chunk", "lang"])
    tiles = ready.mapInArrow(_tiled(size, parts, max(1, turns)), _TILES)
    while turns > FAN_IN:
        # of each part so many chunks at a time
        turns = -(-turns // FAN_IN)
        near = tiles.withColumn("turn", F.floor(F.col("turn") / FAN_IN).cast("int")).repartition(parts, "part", "turn").sortWithinPartitions("part", "turn", "lang")
        tiles = written(near.mapInArrow(_summed, _TILES), "phrase-tiles")
    near = tiles.repartition(parts, "part").sortWithinPartitions("part", "lang")
    found = written(near.mapInArrow(_frequent(size, least), "lang string, i long, j long, k long, a long"), "phrase-candidates")
    dropped(chunks)

    word = lambda x: vocab.select("lang", F.col("id").alias(x), F.col("word").alias(f"w{x}"), F.col("f").alias(f"f{x}"))
    pairs, triples = found.filter("k < 0").drop("k"), found.filter("k >= 0")
    named = lambda x, y, f: pairs.select("lang", F.col("i").alias(x), F.col("j").alias(y), F.col("a").alias(f))
    held = triples.select("lang", "i", "j", "a").unionByName(triples.select("lang", F.col("j").alias("i"), F.col("k").alias("j"), "a")).groupBy("lang", "i", "j").agg(F.max("a").alias("longer"))
    kept = pairs.join(held, ["lang", "i", "j"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    two = kept.join(word("i"), ["lang", "i"]).join(word("j"), ["lang", "j"])
    two = two.select("lang", F.concat_ws(" ", "wi", "wj").alias("phrase"), "a", F.col("fi").alias("l"), F.col("fj").alias("r"), _score("a", F.col("fi"), F.col("fj")).alias("score"))
    three = triples.join(word("i"), ["lang", "i"]).join(word("j"), ["lang", "j"]).join(word("k"), ["lang", "k"]).join(named("i", "j", "fij"), ["lang", "i", "j"]).join(named("j", "k", "fjk"), ["lang", "j", "k"])
    three = three.withColumn("s1", _score("a", F.col("fi"), F.col("fjk"))).withColumn("s2", _score("a", F.col("fij"), F.col("fk")))
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "wi", "wj", "wk").alias("phrase"), "a", F.when(early, F.col("fi")).otherwise(F.col("fij")).alias("l"), F.when(early, F.col("fjk")).otherwise(F.col("fk")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return last.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
