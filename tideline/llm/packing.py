"""Mixture-controlled packing: every window of the packed stream holds the sources in target proportions."""

from __future__ import annotations

import base64
import math
import zlib
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.llm.common import dropped, small, written

LENGTH = 2048
#: Sequences in one window: the stretch within which the sources' proportions are met.
WINDOW_SEQUENCES = 64
#: Rows of the table of (block, queue) offsets that may be broadcast; a larger one is joined by shuffle.
OFFSET_ROWS = 200_000

_TOKENS = "doc_id long, queue string, block int, place long, n int, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, source string"
#: The added token of the JSON file: it is one id wherever a text has it, also in the middle.
SPECIAL = {"<|endoftext|>": 50256}
_encoders: dict[str, object] = {}


def encoder(path: str, pattern: str):
    """The byte-level BPE in ``path`` (ranks of the same vocabulary as the JSON file), kept per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def exact_encoder(path: str):
    """The same vocabulary from its JSON file: slower, without a limit on a run of blanks."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def token_ids(text: str, path: str, pattern: str, json_path: str | None = None) -> list[int]:
    """The ids of a whole text. The pattern's engine gives up on runs of very many blanks; such texts go to the JSON tokenizer."""
    try:
        return encoder(path, pattern).encode(text, allowed_special=set(SPECIAL))
    except ValueError:
        if json_path is None:
            raise
        return exact_encoder(json_path).encode(text, add_special_tokens=False).ids


def _tokens(path: str, pattern: str, eos: int, json_path: str | None):
    def run(batches):
        block, places = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                queues, ns, ids, place = part["queue"].to_pylist(), [], [], []
                for queue, text in zip(queues, part["text"]):
                    own = token_ids(text.as_py() or "", path, pattern, json_path)
                    own.append(eos)
                    place.append(places.get(queue, 0))
                    places[queue] = place[-1] + len(own)
                    ns.append(len(own))
                    ids.append(np.array(own, np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["queue"], pa.array([block] * len(ns), pa.int32()), pa.array(place, pa.int64()), pa.array(ns, pa.int32()), pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "block", "place", "n", "ids"],
                )

    return run


class Plan:
    """Where the stream has which token of which queue: deficit round-robin, in closed form.

    In each round (a window) every queue that isn't dry gets its quantum, ``window`` times its weight over
    the weights of the queues still running, and sends what it has been granted in whole tokens; the part
    of a token that is left is its deficit, which the next round adds to the quantum, over all windows and
    partitions. Queues run dry in the order of total / weight; from there on the others share by their
    weights. Between two such points grants are linear in the stream's length, so exact rationals give the
    grant of any queue by the end of any window, and any task can place any token without the tasks before
    it. With the totals as weights all queues end together.
    """

    def __init__(self, totals: list[int], window: int, weights: list[int] | None = None) -> None:
        self.totals, self.window, self.all = totals, window, sum(totals)
        self.weights = list(weights) if weights is not None else list(totals)
        self._cache: dict[int, tuple[list[int], list[int]]] = {}
        # phases: stream length at the start, what each running queue had been granted for a unit of weight, running weight
        self.start, self.level, self.running = [Fraction(0)], [Fraction(0)], [sum(w for w, t in zip(self.weights, totals) if t)]
        for dry in sorted({Fraction(t, w) for t, w in zip(totals, self.weights) if t}):
            self.start.append(self.start[-1] + (dry - self.level[-1]) * self.running[-1])
            self.level.append(dry)
            self.running.append(self.running[-1] - sum(w for t, w in zip(totals, self.weights) if t and Fraction(t, w) == dry))

    def _level(self, w: int) -> Fraction:
        """Tokens granted to a running queue for a unit of weight by the end of window w - 1."""
        at = min(Fraction(w * self.window), Fraction(self.all))
        k = max(0, bisect_right(self.start, at) - 1)
        return self.level[k] + ((at - self.start[k]) / self.running[k] if self.running[k] else 0)

    def granted(self, q: int, w: int) -> int:
        return min(self.totals[q], math.floor(self.weights[q] * self._level(w)))

    def _window(self, w: int) -> tuple[list[int], list[int]]:
        """For window w: stream positions less queue positions at which the queues begin, and the queues' grants by its end."""
        if w not in self._cache:
            if len(self._cache) > 4096:
                self._cache.clear()
            below, above = self._level(w), self._level(w + 1)
            low, ends = ([min(t, x * y.numerator // y.denominator) for t, x in zip(self.totals, self.weights)] for y in (below, above))
            heads, at = [], sum(low)
            for x, end in zip(low, ends):
                heads.append(at - x)
                at += end - x
            self._cache[w] = heads, ends
        return self._cache[w]

    def window_of(self, q: int, token: int) -> int:
        """The window that grants a token of queue q."""
        level = Fraction(token + 1, self.weights[q])
        k = min(bisect_right(self.level, level), len(self.level)) - 1
        k = k - 1 if self.level[k] == level and k else k
        return math.ceil((self.start[k] + (level - self.level[k]) * self.running[k]) / self.window) - 1

    def pieces(self, q: int, first: int, n: int, length: int):
        """(start, length, stream position, window) of the pieces of tokens first..first+n of queue q."""
        w, at, end = self.window_of(q, first), first, first + n
        while at < end:
            heads, ends = self._window(w)
            head, stop = heads[q], min(end, ends[q])
            while at < stop:
                p = head + at
                take = min(stop - at, length - p % length)
                yield at - first, take, p, w
                at += take
            w += 1


def _cut(totals: dict[str, int], weights: dict[str, int] | None, window: int, length: int):
    names = sorted(totals)

    def run(batches):
        plan = Plan([totals[x] for x in names], window, None if weights is None else [weights[x] for x in names])
        turn = {x: k for k, x in enumerate(names)}
        for batch in batches:
            out = [[] for _ in range(9)]
            for doc, queue, first, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "queue", "first", "n")), batch["ids"]):
                wide = np.frombuffer(ids.as_buffer(), np.uint16).astype("<u4")
                for start, take, p, w in plan.pieces(turn[queue], first, n, length):
                    for column, x in zip(out, (doc, start, take, zlib.crc32(wide[start : start + take]), n, p // length, p % length, w, queue[1:] if queue[0] == "s" else None)):
                        column.append(x)
            kinds = [pa.int64()] * 8 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [f.split()[0] for f in _PIECES.split(", ")])

    return run


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, eos: int = 1, length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES, weights: dict[str | None, int] | None = None,
    json_path: str | None = None,
) -> DataFrame:
    """Packs the tokens of all ``docs(doc_id, text, source)`` into sequences of ``length``.

    A queue per source holds its documents' tokens (each followed by ``eos``); windows of
    ``window_sequences`` sequences draw from the queues by deficit round-robin (``Plan``). Target
    proportions are ``weights`` (source to a positive whole number; sources that it doesn't name weigh 1),
    by default the sources' shares of all tokens, so that every window has them and all queues end
    together; otherwise the sources that are left when one runs dry share its part by their weights. Only
    the very last sequence is short. Documents are cut where a sequence or a queue's share of a window ends.
    Placing takes time in proportion to windows x sources of a task's documents, for any number of sources.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window,
    source. Null text is an empty one (only ``eos``); null source has a queue of its own; null doc_ids are
    kept; repeated rows are packed again each; long texts are tokenised whole (those with a run of blanks
    beyond the pattern engine's stack by the tokenizer at ``json_path``); an empty table gives no piece. Other columns of ``docs``, also those named like an output, aren't read.
    """
    name = F.when(F.col("source").isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), "source"))
    texts = docs.select("doc_id", name.alias("queue"), "text")
    tokens = written(texts.mapInArrow(_tokens(ranks_path, pattern, eos, json_path), _TOKENS), "pack-tokens")
    blocks = written(tokens.groupBy("queue", "block").agg(F.sum("n").alias("n")), "pack-blocks")
    totals = {r["queue"]: int(r["n"]) for r in blocks.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row per source
    shares = None
    if weights is not None:
        known = {"z" if s is None else f"s{s}": int(w) for s, w in weights.items()}
        if any(w <= 0 for w in known.values()):
            raise ValueError("weights are positive whole numbers")
        shares = {q: known.get(q, 1) for q in totals}
    heads = blocks.withColumn("head", F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    heads = written(heads.select("queue", "block", "head"), "pack-heads")
    dropped(blocks)
    located = tokens.join(small(heads, OFFSET_ROWS), ["queue", "block"]).select("doc_id", "queue", (F.col("head") + F.col("place")).alias("first"), "n", "ids")
    return located.mapInArrow(_cut(totals, shares, length * window_sequences, length), _PIECES)
