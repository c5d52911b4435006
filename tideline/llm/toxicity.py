"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Words, crc_mod, dropped, mix64, slices, written

#: Mass of the Dirichlet prior of each word, in occurrences, and standard errors by which log-odds are pulled to zero.
PRIOR, ERRORS = 2.0, 3.0
#: Labelled documents of each class that the lexicon learns from, at most (about; taken by a hash of the doc_id).
SAMPLE_DOCS = 20_000
#: One in so many training documents is left to the calibration.
CALIBRATE = 4
#: A passage is significant if one as good is expected in so many clean texts of that length at most.
LEVEL = 0.01
#: Labels up to so many rows are broadcast to the documents; more are joined by shuffle.
LABEL_ROWS = 500_000
#: Evidence counts up to this in the logistic curve.
MOST_EVIDENCE = 50.0


def _contexts(batches):
    """(word, context, toxic): each word of a document once, with the words around its first place."""
    for batch in batches:
        for part in slices(batch, "text"):
            toxic = part["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            words = Words(part["text"], letters=True)
            if not len(words.hash):
                continue
            edge = np.zeros(1, np.uint64)
            same = words.doc[1:] == words.doc[:-1]
            before, after = np.r_[edge, np.where(same, words.hash[:-1], 0)], np.r_[np.where(same, words.hash[1:], 0), edge]
            order = np.lexsort((np.arange(len(words.hash)), words.hash, words.doc))
            first = order[np.r_[True, (words.doc[order][1:] != words.doc[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])]]
            context = mix64(before[first] + np.uint64(1)) + mix64(after[first] + np.uint64(3)) * np.uint64(5)
            yield pa.RecordBatch.from_arrays([pa.array(words.hash[first].view(np.int64)), pa.array(context.view(np.int64)), pa.array(toxic[words.doc[first]])], ["word", "context", "toxic"])


def lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted word hashes, their scores, and the cost of any other word, from (text, toxic) rows.

    A word counts once a document, and once for all documents that have it between the same two words, so
    neither long documents nor copies speak many times. Log-odds of these counts have an informative
    Dirichlet prior (PRIOR occurrences a word, at the rate of all words) and are pulled to zero by ERRORS
    standard errors. All scores are then lowered by one constant so that the mean of exp(score) over clean
    words is 1: the condition under which the best of random segments has rate 1 and no drift upwards.
    """
    seen = labelled.mapInArrow(_contexts, "word long, context long, toxic boolean").groupBy("word", "context", "toxic").agg(F.lit(1).alias("one"))
    counts = written(seen.groupBy("word").agg(F.count(F.when(F.col("toxic"), 1)).alias("bad"), F.count(F.when(~F.col("toxic"), 1)).alias("good")), "toxic-words")
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    n1, n0 = float(total["bad"] or 0), float(total["good"] or 0)
    if not n1 or not n0:
        dropped(counts)
        return np.zeros(0, np.uint64), np.zeros(0), 0.1
    bad, good = F.col("bad") + PRIOR * n1 / (n1 + n0), F.col("good") + PRIOR * n0 / (n1 + n0)
    odds = F.log(bad / good) - float(np.log(n1 / n0))
    pulled = F.signum("odds") * (F.abs("odds") - ERRORS * F.sqrt(1 / bad + 1 / good))
    kept = counts.withColumn("odds", odds).withColumn("score", pulled).filter((F.signum("odds") == F.signum("score")) & (F.col("score") != 0)).select("word", "good", "score").toArrow()
    dropped(counts)
    words, score = kept["word"].to_numpy().astype(np.int64).view(np.uint64), kept["score"].to_numpy().astype(float)
    cost = float(np.log1p(np.sum(kept["good"].to_numpy() / n0 * np.expm1(score)))) if len(score) else 0.1
    order = np.argsort(words)
    return words[order], score[order] - max(cost, 1e-4), max(cost, 1e-4)


def segments(at: np.ndarray, score: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) in linear time, by the cumulative-score scan.

    ``at``/``score``: positions and scores of the words with one of their own, in order; every other word costs ``penalty``.
    """
    found: list[list[float]] = []  # begin, end, cumulative before, cumulative after, link to an earlier one
    level, last = 0.0, 0
    for k, s in zip(at.tolist(), score.tolist()):
        level -= penalty * (k - last)
        low, high = level, level + s
        level, last = high, k + 1
        if s <= 0:
            continue
        begin, j = k, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= high:
                found.append([begin, k + 1, low, high, j])
                break
            begin, low = found[j][0], found[j][2]
            del found[j:]
            j -= 1
    return [(int(b), int(e), h - l) for b, e, l, h, _ in found]


def _scan(keys: np.ndarray, odds: np.ndarray, penalty: float):
    """Per document: words, best segment's score, number of segments, and the segments in words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"], letters=True)
                n = np.diff(words.first)
                spot = np.searchsorted(keys, words.hash) if len(keys) else np.zeros(len(words.hash), np.int64)
                hit = np.flatnonzero(keys[np.minimum(spot, len(keys) - 1)] == words.hash) if len(keys) else np.zeros(0, np.int64)
                best, many, passages = np.zeros(len(n)), np.zeros(len(n), np.int64), [[] for _ in n]
                rows, first = words.doc[hit], np.searchsorted(words.doc[hit], np.arange(len(n) + 1))
                for row in np.unique(rows).tolist():
                    own = hit[first[row] : first[row + 1]]
                    found = segments(own - words.first[row], odds[spot[own]], penalty)
                    best[row], many[row] = max((s for _, _, s in found), default=0.0), len(found)
                    passages[row] = [{"first": b, "end": e, "score": s} for b, e, s in found]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n.astype(np.int64)), pa.array(best), pa.array(many), pa.array(passages, kind)], ["doc_id", "n", "best", "many", "passages"])

    return run


_SCANNED = "doc_id long, n long, best double, many long, passages array<struct<first: long, end: long, score: double>>"


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge; w: rows that each x stands for."""
    b = np.zeros(2)
    m = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
        g = m.T @ (w * (y - p)) - 0.01 * b
        h = (m * (w * p * (1 - p))[:, None]).T @ m + 0.01 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(b[0]), float(b[1])


def extreme_values(n: np.ndarray, best: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(rate, density) of the law P(best <= x) = exp(-density n exp(-rate x)), by maximum likelihood over clean texts.

    ``weight``: texts that each pair of length and best score stands for. For a rate the best density is in
    closed form; the slope of the likelihood falls with the rate, so bisection finds its zero.
    """
    total = weight.sum()

    def slope(rate: float) -> float:
        e = weight * n * np.exp(-rate * best)
        return total / rate - (weight * best).sum() + total * (e * best).sum() / e.sum()

    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, float(total / (weight * n * np.exp(-low * best)).sum())


def judge_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores ``docs(doc_id, text)`` for toxicity as ``labels(doc_id, toxic)`` marks it.

    Everything learns from labelled rows whose crc32(doc_id) mod ``folds`` is not ``held``: the lexicon from
    SAMPLE_DOCS documents of each class at most, the law of extreme values from the clean ones of the rest
    (one in CALIBRATE is left for that), the logistic curve from all of these. A document's evidence is
    -ln p of its best segment's score under the law. A passage is returned if it is significant: density x
    words x exp(-rate x score) <= LEVEL.

    Returns doc_id, held_out, score (0 to 1), predicted, passages (first word, end, score; words are runs
    of letters, and texts of any length are scanned whole). Null and empty texts have no evidence and get
    the curve's intercept. Labels that repeat a doc_id count as toxic if any does; null labels are ignored.
    Without both classes all scores are 0. Repeated documents are scored each; an empty table gives no rows;
    other columns aren't read, whatever their names.
    """
    held_out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    marks = marks.filter(crc_mod("id", folds) != held).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CALIBRATE))).withColumn("luck", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)))
    marks = written(marks, "toxic-labels")
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic"), SAMPLE_DOCS / max(1, counts.get(True, 0))).otherwise(SAMPLE_DOCS / max(1, counts.get(False, 0))) * (1 << 20)
    joined = F.broadcast(marks) if sum(counts.values()) <= LABEL_ROWS else marks
    text = docs.select("doc_id", "text")
    learn = marks.filter((F.col("part") != 0) & (F.col("luck") < share)).select("id", "toxic")  # 2 x SAMPLE_DOCS rows or so
    keys, odds, penalty = lexicon(text.join(F.broadcast(learn), F.col("doc_id") == F.col("id")).select("text", "toxic"))
    scanned = written(text.mapInArrow(_scan(keys, odds, penalty), _SCANNED), "toxic-scanned")
    train = scanned.select("doc_id", "n", "best").join(joined.filter("part = 0"), F.col("doc_id") == F.col("id"))
    clean = train.filter("not toxic and n > 0").groupBy((F.round(F.log2("n") * 4) / 4).alias("n"), (F.round(F.col("best") * 16) / 16).alias("best")).agg(F.count("*").alias("w")).orderBy("n", "best").collect()
    rate, density = 1.0, 1.0
    if clean:
        n, best, w = (np.array([float(r[c]) for r in clean]) for c in ("n", "best", "w"))
        rate, density = extreme_values(2.0**n, best, w)
    log_tail = float(np.log(density)) + F.log(F.greatest("n", F.lit(1)).cast("double")) - F.lit(rate) * F.col("best")
    evidence = F.when(log_tail < -12, -log_tail).otherwise(-F.log(-F.expm1(-F.exp(log_tail))))
    evidence = F.when(F.col("best") > 0, F.greatest(F.lit(0.0), F.least(evidence, F.lit(MOST_EVIDENCE)))).otherwise(F.lit(0.0))
    bins = train.select((F.round(evidence * 8) / 8).alias("x"), F.col("toxic").cast("int").alias("toxic")).groupBy("x", "toxic").agg(F.count("*").alias("n")).orderBy("x", "toxic").collect()
    slope, base = 0.0, -30.0
    if len({r["toxic"] for r in bins}) > 1:
        slope, base = _logistic(*(np.array([float(r[c]) for r in bins]) for c in ("x", "toxic", "n")))
    dropped(marks)
    score = 1 / (1 + F.exp(-(F.lit(slope) * evidence + F.lit(base))))
    least = (F.log(F.greatest("n", F.lit(1)).cast("double")) + float(np.log(density) - np.log(LEVEL))) / F.lit(rate)
    passages = F.filter("passages", lambda p: p["score"] >= least)
    return scanned.withColumn("score", score).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), passages.alias("passages"))
