"""Helpers that the corpus operators share: written tables, checked broadcasts, byte tokenising."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
_recorders: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; on one machine only, a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own_dir.setdefault("path", tempfile.mkdtemp(prefix="tideline-"))


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    for made in _recorders:
        made.append(out)
    return out


@contextmanager
def recording():
    """The tables that are written inside, so that their owner can drop them once its result is written."""
    made: list[DataFrame] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders[:] = [m for m in _recorders if m is not made]


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_tideline_path", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Marks a written table for broadcast if its counted rows are at most ``rows``; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A 64-bit hash of whole rows, whatever their columns are called and hold (nested ones as JSON)."""
    kinds = dict(df.dtypes)
    plain = lambda c: F.col(f"`{c}`") if not kinds[c].startswith(("map", "struct", "array", "variant")) else F.to_json(F.struct(F.col(f"`{c}`").alias("v")))
    names = columns if columns is not None else df.columns
    marks = F.concat_ws("", *[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in names])  # a null isn't skipped
    return F.xxhash64(marks, *[plain(c) for c in names])


# ---------------------------------------------------------------- byte tokenising with numpy

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARKS = np.array([b < 128 and not (65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts as 64-bit hashes.

    ``hash``: one per word; ``doc``: the row of each word; ``start``/``end``: byte positions in ``data``
    (A-Z lower-cased); ``first``: index of the first word of each row, with the total at the end.
    Only white space 0x20 and 0x09-0x0D separates words, or with ``letters`` every ASCII character that
    is no letter; rows never share a word. Null is no word.
    """

    def __init__(self, texts, letters: bool = False) -> None:
        import pyarrow as pa

        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and n else np.zeros(0, np.uint8)
        bound = offsets - offsets[0]
        self.n_rows, self.data = n, _LOWER[raw]
        solid = ~(_MARKS if letters else _SPACE)[self.data]
        # a word starts at a solid byte after a space or at a row's first byte
        prev = np.empty_like(solid)
        prev[:1], prev[1:] = False, solid[:-1]
        begin = bound[:-1][bound[:-1] < len(raw)]
        cut = prev.copy()
        cut[begin] = False
        self.start = np.flatnonzero(solid & ~cut)
        after = np.empty_like(solid)
        after[-1:], after[:-1] = False, solid[1:]
        last = bound[1:][bound[1:] > 0] - 1
        after[last] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.doc = np.searchsorted(bound, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, bound)
        up, down = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * up[: len(raw)], out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def slices(batch, column: str, most: int = 1_000_000):
    """Cuts an Arrow batch so that a slice has about ``most`` bytes of text, or a single row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)
    trimmed()


def trimmed() -> None:
    """Gives freed memory back to the system: Python workers stay alive between tasks and share an executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def byte_words(texts, solid: np.ndarray, apart: np.ndarray | None = None):
    """The words of a batch of texts as they are: runs of bytes that ``solid`` (a table of 256) marks, A-Z lower-cased.

    Returns the words as a large string array, the first word of each row (with the total at the end), and
    for each word a number that grows where a byte of ``apart`` stands between it and the word before.
    Rows never share a word; null is an empty text.
    """
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = _LOWER[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None and n else np.zeros(0, np.uint8)
    bound = offsets - offsets[0]
    inside = solid[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    head = bound[:-1][bound[:-1] < len(data)]
    begins[head] = inside[head]
    start = np.flatnonzero(begins)
    kept = np.cumsum(inside)
    at = kept[start] - 1 if len(start) else np.zeros(0, np.int64)
    ends = np.append(at, kept[-1] if len(kept) else 0).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside])))
    pieces = np.cumsum(apart[data])[start] if apart is not None and len(start) else np.zeros(len(start), np.int64)
    return words, np.searchsorted(start, bound), pieces
