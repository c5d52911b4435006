"""Phrases, ranked search and fingerprints against brute force, and on rows that are null, empty, long or repeated."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, n long, score double, rank int, words string, id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(40)] + ["Été", "ÉTÉ", "naïve", "x-y", "a#b"]
    odds = [1 / (k + 1) for k in range(len(vocab))]
    out = []
    for _ in range(160):
        words = rng.choices(vocab, odds, k=rng.randrange(1, 90))
        out.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", " New York City ", " new york "]) for w in words))
    out += ["", None, " \t ", "...", "one", "one", "ha " * 60, "w1 w2 w3 " * 4000, "Z" * 200_000, " " * 300_000, "w1,w2,w3\x0bw1\x0cw2"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, [None, "en", "de", "en"][k % 4], 1, 1.0, 2, "x", "y") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "w1 w2 new york city", "en", 1, 1.0, 2, "x", "y")], SCHEMA).repartition(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def phrases_by_hand(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if any(100 * c[q] >= 50 * a for q in c if len(q) > len(p) and c[q] >= least and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("fan_in", [256, 2])
def test_phrases(docs, empty, monkeypatch, fan_in):
    from tideline.llm import phrases as P

    monkeypatch.setattr(P, "FAN_IN", fan_in)  # with 2, parts are summed up over rounds
    got = P.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand([(r.text, r.lang) for r in docs.select("text", "lang").collect()])
    if fan_in == 2:
        few = sorted(map(tuple, P.collocations(docs, top=3).collect()))
        assert few == phrases_by_hand([(r.text, r.lang) for r in docs.select("text", "lang").collect()], top=3)
        assert P.collocations(empty).count() == 0


def test_tiles_are_dense_or_sparse_alike():
    from tideline.llm.phrases import count_tiles, edges

    rng = np.random.default_rng(2)
    side = edges(3000)
    assert side[0] == 0 and np.all(np.diff(side) > 0) and np.diff(side).max() <= 1024
    for size in (0, 10, 200_000):  # sparse tiles only, and dense ones at the head
        row, col, n = (rng.zipf(1.4, size) % 3000, rng.zipf(1.4, size) % 3000, rng.integers(1, 5, size))
        want = Counter()
        for i, j, k in zip(row.tolist(), col.tolist(), n.tolist()):
            want[i, j] += k
        i, j, a = count_tiles(row, col, n, side, side)
        assert len(i) == len(want) and dict(zip(zip(i.tolist(), j.tolist()), a.tolist())) == dict(want)


def ranked_by_hand(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_search(spark, docs, empty):
    from tideline.llm.search import rank_documents

    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(40)] + ["été", "naïve", "york", "zzz", "one"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(1, 90)))) for k in range(30)] + [(30, None), (31, ""), (32, "unseen"), (None, "york w1"), (3, "york"), (33, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = ranked_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)
    for got in (rank_documents(docs, bench), rank_documents(docs, bench, entries_at_once=100)):  # in several rounds
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert rank_documents(empty, bench).count() == 0 and rank_documents(docs, bench.limit(0)).count() == 0


def test_masks_stop_early_and_miss_nothing():
    from tideline.llm.search import Best, rank_block

    rng = np.random.default_rng(3)
    n, t = 5000, 70  # masks over two words
    for spread in (0.02, 0.5):
        held = rng.random((t, n)) < spread * rng.random((t, 1))
        term, doc = np.nonzero(held)
        gain = rng.integers(1, 1000, len(term)) * rng.integers(1, 50, t)[term]
        where, most = np.searchsorted(term, np.arange(t + 1)), np.zeros(t, np.int64)
        np.maximum.at(most, term, gain)
        score = np.bincount(doc, gain, n).astype(np.int64)
        best = Best(10)
        seen = rank_block(best, np.arange(t), np.packbits(held, axis=1), where, doc, gain, most, np.arange(n))
        order = np.lexsort((np.arange(n), -score))[:10]
        assert best.id.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
        again = rank_block(best, np.arange(t), np.packbits(held, axis=1), where, doc, gain // 4, most // 4, np.arange(n))
        assert seen < n and again < seen


def test_fingerprints(spark, docs, empty):
    from tideline.llm.fingerprints import fingerprints

    got = fingerprints(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    order = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
    text = dict(rows)
    follow = {i: text[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    edited = lambda i: text[i][: len(text[i]) - len(text[i]) // 4] + follow[i][: len(text[i]) // 4]
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    prints = defaultdict(set)
    for r in got:
        assert r.n_chars == len(text[r.doc_id]) and r.edited_sha256 == hashlib.sha256(edited(r.doc_id).encode()).hexdigest()
        prints[text[r.doc_id]].add(r.fingerprint)
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1) and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in prints.values())
    cut = lambda t: Counter(re.findall(r"[^\x20\x09-\x0D]{1,16}", t))

    def jaccard(a, b):
        a, b = cut(a), cut(b)
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    for near, other in (("near_edited", edited), ("near_next", follow.get)):
        off = np.array([r[near] - jaccard(text[r.doc_id], other(r.doc_id)) for r in got])
        assert abs(off.mean()) < 0.04 and np.sqrt((off**2).mean()) < 0.1  # texts share words, so their errors go together
    assert fingerprints(empty).count() == 0
    one = fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest() and one.near_next == 1.0


def test_samples_collide_like_weights(spark):
    """Weights of many sizes: the share of equal samples is the generalised Jaccard similarity."""
    from tideline.llm.fingerprints import fingerprints

    rng = random.Random(8)
    pairs = []
    for k in range(0, 120, 2):
        a = {f"t{k}.{j}": rng.randrange(1, 30) for j in range(40)}
        b = {t: max(1, round(w * rng.choice([1, 1, 0.5, 2]))) for t, w in a.items() if rng.random() < 0.8}
        pairs += [(k, " ".join(t for t, w in a.items() for _ in range(w))), (k + 1, " ".join(t for t, w in b.items() for _ in range(w)))]
    got = {r.doc_id: r.near_next for r in fingerprints(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    weigh = [Counter(t.split()) for _, t in pairs]
    off = np.array([got[k] - sum((weigh[k] & weigh[k + 1]).values()) / sum((weigh[k] | weigh[k + 1]).values()) for k in range(0, 120, 2)])
    assert abs(off.mean()) < 0.03 and np.sqrt((off**2).mean()) < 0.12


def test_fingerprints_are_native(docs):
    from tideline.llm.fingerprints import fingerprints

    plan = fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("MapInArrow|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", plan.split("== Physical Plan ==")[-1])


def test_packing_of_very_long_blanks(spark):
    import public_tokenizers as t

    from tideline.llm.packing import pack

    docs = spark.createDataFrame([(1, "x" + " " * 1_000_000 + "y", "a"), (2, "q" * 500_000, "b"), (3, "z", None)], "doc_id long, text string, source string")
    got = pack(docs, t.path("byte_bpe_50k.tiktoken"), t.PATTERN, json_path=t.path("byte_bpe_50k.json")).groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert all(r["doc_tokens"] == r["sum(length)"] for r in got) and {r["doc_id"]: r["doc_tokens"] for r in got}[1] == 1_000_002
