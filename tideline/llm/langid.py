"""Language of every word and text by a linear-chain conditional random field."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.llm.common import Words, crc_mod, mix64, slices, trimmed

#: Hash buckets of the word features.
DIM = 1 << 17
#: Bounds of the training sample: documents of each language, bytes of one, words of all.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_WORDS = 250, 20_000, 120_000
#: Words of a training sequence and of a block of the parallel forward-backward pass.
SEQUENCE, BLOCK = 24, 32
EPOCHS, RATE, RIDGE = 25, 0.3, 1e-5
#: Words whose features are made at once, and words that a task remembers the scores of.
CHUNK, CACHE = 16_384, 250_000


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of words, flat, with the first of each word: byte n-grams of ^word$ (those with ^
    or $ are its affixes) of one to four bytes, and the whole word as its lexicon entry."""
    n = end - start
    size = n + 2
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(n)), size)
    at = np.arange(first[-1]) - first[word]
    byte = np.full(first[-1], 1, np.uint64)  # ^
    inner = (at > 0) & (at <= n[word])
    byte[inner] = data[(start[word] + at - 1)[inner]]
    byte[at == n[word] + 1] = 2  # $
    left = size[word] - at  # characters up to the word's end
    buckets = []
    code = np.zeros(len(byte), np.uint64)
    for k in range(1, 5):
        code[: len(byte) - k + 1] = code[: len(byte) - k + 1] * np.uint64(257) + byte[k - 1 :] if k > 1 else byte
        good = (left >= k) & ((k > 1) | inner)
        h = (mix64(code + np.uint64(k << 40)) % np.uint64(DIM)).astype(np.int64)
        buckets.append(np.where(good, h, DIM))
    prefix = np.cumsum(mix64(byte * np.uint64(1000003) + at.astype(np.uint64)))
    head = np.concatenate([[np.uint64(0)], prefix[first[1:-1] - 1]]) if len(n) else np.zeros(0, np.uint64)
    whole = (mix64(prefix[first[1:] - 1] - head) % np.uint64(DIM)).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    table = np.stack(buckets, 1)  # one row per position
    flat = np.insert(table.reshape(-1), first[:-1] * 4, whole)
    return flat, first[:-1] * 4 + np.arange(len(n))


class Crf:
    """Unary weights of hashed features and transitions; scores of a word don't depend on its neighbours."""

    def __init__(self, labels: list[str]) -> None:
        k = len(labels)
        self.labels, self.weights, self.moves = labels, np.zeros((DIM + 1, k), np.float32), np.eye(k) * 1.0

    def unary(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(start) > CHUNK:
            return np.concatenate([self.unary(data, start[k : k + CHUNK], end[k : k + CHUNK]) for k in range(0, len(start), CHUNK)])
        if not len(start):
            return np.zeros((0, len(self.labels)))
        flat, first = features(data, start, end)
        count = np.diff(np.append(first, len(flat)))
        return np.add.reduceat(self.weights[flat], first, axis=0).astype(float) / np.sqrt(count)[:, None]

    def fit(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, label: np.ndarray, sequence: np.ndarray) -> None:
        """Maximum likelihood by Adagrad over forward-backward passes; ``sequence`` numbers rising runs of words."""
        k = len(self.labels)
        chunks = []  # of words: their places, feature buckets, and the first of each word; all at once would fill a driver
        for c in range(0, len(start), CHUNK):
            flat, first = features(data, start[c : c + CHUNK], end[c : c + CHUNK])
            chunks.append((slice(c, c + len(first)), flat.astype(np.int32), first))
        scale = 1 / np.sqrt(np.concatenate([np.diff(np.append(first, len(flat))) for _, flat, first in chunks]))
        begin = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        length = np.diff(np.append(begin, len(sequence)))
        at = begin[:, None] + np.arange(length.max())
        real = np.arange(length.max()) < length[:, None]
        at = np.where(real, at, 0)
        truth = np.eye(k)[label]
        pairs = real[:, 1:]
        seen = np.zeros((k, k))
        np.add.at(seen, (label[at[:, :-1]][pairs], label[at[:, 1:]][pairs]), 1)
        grown, grown_moves = np.full((DIM + 1, k), 1e-8), np.full((k, k), 1e-8)
        for _ in range(EPOCHS):
            u = (np.concatenate([np.add.reduceat(self.weights[flat], first, axis=0) for _, flat, first in chunks]) * scale[:, None])[at]  # sequence, step, label
            u = np.where(real[:, :, None], u, 0.0)
            m = np.exp(self.moves)
            e = np.exp(u - u.max(2, keepdims=True))
            steps = e.shape[1]
            a, b = np.zeros_like(e), np.ones_like(e)
            a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for t in range(1, steps):
                x = (a[:, t - 1] @ m) * e[:, t]
                a[:, t] = np.where(real[:, t, None], x / x.sum(1, keepdims=True), a[:, t - 1])
            for t in range(steps - 2, -1, -1):
                x = (b[:, t + 1] * e[:, t + 1]) @ m.T
                b[:, t] = np.where(real[:, t + 1, None], x / x.sum(1, keepdims=True), b[:, t])
            p = a * b
            p /= p.sum(2, keepdims=True)
            grad = np.zeros((len(start), k))
            grad[at[real]] = p[real]
            grad = (grad - truth) * scale[:, None]
            full = np.zeros((DIM + 1, k))
            for own, flat, first in chunks:
                word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(flat))))
                for j in range(k):
                    full[:, j] += np.bincount(flat, grad[own, j][word], DIM + 1)
            full /= len(length)
            full[DIM] = 0
            full += RIDGE * self.weights
            joint = a[:, :-1, :, None] * m * (e * b)[:, 1:, None, :]
            joint /= joint.sum((2, 3), keepdims=True)
            moves = (joint[pairs].sum(0) - seen) / len(length)
            grown += full**2
            grown_moves += moves**2
            self.weights -= (RATE * full / np.sqrt(grown)).astype(np.float32)
            self.moves -= RATE * moves / np.sqrt(grown_moves)

    def marginals(self, u: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Per word the label chances by forward-backward over its whole document.

        Exact for any length: blocks of BLOCK words get their transfer matrices in lock-step, a scan over a
        document's blocks gives the messages at block borders, and a second lock-step pass the words between.
        """
        k = len(self.labels)
        if not len(u):
            return np.zeros((0, k))
        m = np.exp(self.moves - self.moves.max())
        e = np.exp(u - u.max(1, keepdims=True))
        length = np.bincount(doc, minlength=n_docs)
        blocks = -(-length // BLOCK)
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        place = np.arange(len(u)) - np.concatenate([[0], np.cumsum(length)])[doc]
        cell = (place % BLOCK, first_block[doc] + place // BLOCK)
        total = int(first_block[-1])
        grid, real = np.ones((BLOCK, total, k)), np.zeros((BLOCK, total), bool)
        grid[cell], real[cell] = e, True
        opening = np.zeros(total, bool)
        opening[first_block[:-1][blocks > 0]] = True
        move = np.eye(k)[None].repeat(total, 0)  # transfer matrix of each block
        for t in range(BLOCK):
            step = m[None] * grid[t][:, None, :]
            if t == 0:
                step = np.where(opening[:, None, None], np.ones((k, k)) * grid[t][:, None, :], step)
            x = move @ step
            x /= x.sum((1, 2), keepdims=True)
            move = np.where(real[t][:, None, None], x, move)
        into, out = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)
        order = np.argsort(-blocks, kind="stable")
        many = blocks[order]
        for j in range(1, int(many[0])):
            at = first_block[order[: np.searchsorted(-many, -j, side="left")]] + j
            x = np.einsum("bi,bij->bj", into[at - 1], move[at - 1])
            into[at] = x / x.sum(1, keepdims=True)
            end = first_block[1:][order[: len(at)]] - 1 - j
            x = np.einsum("bij,bj->bi", move[end + 1], out[end + 1])
            out[end] = x / x.sum(1, keepdims=True)
        a = np.empty_like(grid)
        carry = into
        for t in range(BLOCK):
            x = (np.where(opening[:, None], 1.0, carry @ m) if t == 0 else carry @ m) * grid[t]
            x /= x.sum(1, keepdims=True)
            carry = a[t] = np.where(real[t][:, None], x, carry)
        carry = out
        for t in range(BLOCK - 1, -1, -1):
            a[t] *= carry
            x = (carry * grid[t]) @ m.T
            carry = np.where(real[t][:, None], x / x.sum(1, keepdims=True), carry)
        p = a[cell]
        return p / p.sum(1, keepdims=True)


def _has_letter(texts) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def train(docs: DataFrame) -> Crf | None:
    """Fits a field on a bounded sample of ``docs(text, lang)``; a word's label is its document's language.

    The sample takes SAMPLE_DOCS documents of each language by a hash of the text, of at most SAMPLE_BYTES
    bytes each. Sequences of SEQUENCE words are made of two stretches of different documents, half of the
    time of different languages, so that transitions learn to switch.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * SAMPLE_DOCS / n))])
    luck = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    rows = known.filter(luck < share[F.col("lang")]).select("lang", "text", luck.alias("luck")).orderBy("luck", "text").limit(int(1.5 * SAMPLE_DOCS * len(counts))).collect()
    labels = sorted(counts)
    own: dict[str, int] = {}
    rows = [r for r in rows if (own.update({r["lang"]: own.get(r["lang"], 0) + 1}) or own[r["lang"]]) <= SAMPLE_DOCS]
    words = Words(pa.array([r["text"] for r in rows], pa.large_string()))
    rng = np.random.Generator(np.random.PCG64(5))
    half = SEQUENCE // 2
    stretches: list[tuple[int, int, int]] = []
    for k, r in enumerate(rows):
        low, high = int(words.first[k]), int(words.first[k + 1])
        stretches += [(i, min(i + half, high), labels.index(r["lang"])) for i in range(low, high, half)]
    order = rng.permutation(len(stretches))
    by_label: dict[int, list[int]] = {}
    for i in order.tolist():
        by_label.setdefault(stretches[i][2], []).append(i)
    picks, total = [], 0
    while total < SAMPLE_WORDS and any(by_label.values()):
        open_labels = [x for x, v in by_label.items() if v]
        one = int(rng.choice(open_labels))
        pair = [by_label[one].pop()]
        others = [x for x in open_labels if x != one and by_label[x]] if rng.random() < 0.5 else [one] if by_label[one] else []
        if others:
            pair.append(by_label[int(rng.choice(others))].pop())
        picks.append(pair)
        total += sum(stretches[i][1] - stretches[i][0] for i in pair)
    at = np.concatenate([np.arange(stretches[i][0], stretches[i][1]) for pair in picks for i in pair]).astype(np.int64)
    label = np.concatenate([np.full(stretches[i][1] - stretches[i][0], stretches[i][2]) for pair in picks for i in pair])
    sequence = np.concatenate([np.full(sum(stretches[i][1] - stretches[i][0] for i in pair), k) for k, pair in enumerate(picks)])
    field = Crf(labels)
    field.fit(words.data, words.start[at], words.end[at], label, sequence)
    trimmed()
    return field


def _label(field: Crf | None, column: str = "text"):
    def run(batches):
        known, scores = np.zeros(0, np.uint64), np.zeros((0, len(field.labels) if field else 0))
        for batch in batches:
            for part in slices(batch, column, 1_000_000):
                n = part.num_rows
                best, score, share = np.full(n, -1), np.zeros(n), np.zeros(n)
                if field:
                    words = Words(part[column])
                    unique, sample, back = np.unique(words.hash, return_index=True, return_inverse=True)
                    spot = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
                    new = known[spot] != unique if len(known) else np.ones(len(unique), bool)
                    fresh = field.unary(words.data, words.start[sample[new]], words.end[sample[new]])
                    letters = np.concatenate([[0], np.cumsum((words.data >= 128) | ((words.data >= 97) & (words.data <= 122)))])
                    bare = letters[words.end[sample[new]]] == letters[words.start[sample[new]]]
                    fresh[bare] = 0.0  # words without letters say nothing
                    u = np.empty((len(unique), len(field.labels)))
                    u[~new], u[new] = scores[spot[~new]] if len(known) else u[~new], fresh
                    if len(known) + new.sum() > CACHE:
                        known, scores = unique, u
                    else:
                        known, scores = np.concatenate([known, unique[new]]), np.concatenate([scores, fresh])
                        order = np.argsort(known)
                        known, scores = known[order], scores[order]
                    p = field.marginals(u[back], words.doc, n)
                    weigh = (letters[words.end] - letters[words.start]).astype(float)
                    total = np.stack([np.bincount(words.doc, p[:, j] * weigh, n) for j in range(len(field.labels))], 1)
                    mass = total.sum(1)
                    good = (mass > 0) & _has_letter(part[column])
                    best[good] = total[good].argmax(1)
                    score[good] = total[good].max(1) / mass[good]
                    turn = (p.argmax(1)[1:] != p.argmax(1)[:-1]) & (words.doc[1:] == words.doc[:-1]) if len(p) else np.zeros(0, bool)
                    share = np.bincount(words.doc[1:], turn, n) if len(p) > 1 else share
                names = [*(field.labels if field else []), "und"]
                out = [pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(score), pa.array(share.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, "lang_pred", "lang_score", "n_switches"])

    return run


def label_language(docs: DataFrame, folds: int = 4, held: int = 2, learn: DataFrame | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` with held_out, lang_pred, lang_score and n_switches.

    The field learns from rows (of ``learn``, default ``docs``) with a language whose crc32(doc_id) mod
    ``folds`` is not ``held``. Words are labelled by forward-backward over the whole text; a text's
    language has most of the letter-weighted marginals, lang_score its share, and n_switches counts
    words labelled other than the word before. Texts that are null or have no letter are ``und`` with
    score 0; so are all without training rows. Repeated rows are labelled each; columns named like an
    output are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "n_switches", "held_out")
    source = learn if learn is not None else docs
    field = train(source.filter(crc_mod("doc_id", folds) != held).select("text", "lang"))
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double").add("n_switches", "long")
    return docs.mapInArrow(_label(field), schema).withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)))
