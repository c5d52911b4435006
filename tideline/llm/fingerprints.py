"""Document fingerprints by consistent weighted sampling, in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.llm.common import dropped, written

#: Samples of a fingerprint: the likeness of two fingerprints strays by at most 1 / (2 sqrt(SAMPLES)).
SAMPLES = 48
#: A term is a run without white space; longer runs count in pieces of so many characters.
TERM = r"[^\x20\x09-\x0D]{1,16}"
#: What a text without terms has in place of a sample.
NOTHING = "----"


def _terms(both: DataFrame, keep: list[str]) -> DataFrame:
    """keep, h, w, side: the weighted terms of ``text`` (side 0) and ``edited`` (1); 2 where both have a term as often.

    The lowest bit of a term's hash names the text, so one sort brings the runs of both beside each other;
    a run's length is the distance of its end from the end before. Texts without terms have one row with null h.
    """
    hashed = lambda t, bit: F.transform(F.regexp_extract_all(t, F.lit(TERM), F.lit(0)), lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    rows = both.select(*keep, F.sort_array(F.concat(hashed("text", 0), hashed("edited", 1))).alias("s"))
    ends = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: ~F.get("s", i).eqNullSafe(F.get("s", i + 1)))
    rows = rows.select(*keep, "s", F.when(F.size("s") > 0, ends).alias("e"))
    rows = rows.select(*keep, "s", "e", F.posexplode_outer("e").alias("j", "at"))
    end = lambda k: F.when(F.col("j") + k < 0, F.lit(-1)).otherwise(F.get("e", F.col("j") + k))
    rows = rows.select(*keep, F.get("s", "at").alias("x"), (F.col("at") - end(-1)).alias("w"), F.get("s", end(-1)).alias("x_before"), (end(-1) - end(-2)).alias("w_before"), F.get("s", F.col("at") + 1).alias("x_after"), (end(1) - F.col("at")).alias("w_after"))
    twin = F.col("x").bitwiseXOR(F.lit(1))
    second = F.col("x").bitwiseAND(F.lit(1)) == 1
    alike = lambda of: F.coalesce((F.col(f"x_{of}") == twin) & (F.col(f"w_{of}") == F.col("w")), F.lit(False))
    side = F.when(second, F.when(alike("before"), -1).otherwise(1)).otherwise(F.when(alike("after"), 2).otherwise(0))
    return rows.select(*keep, F.col("x").bitwiseAND(F.lit(-2)).alias("h"), "w", side.alias("side")).filter("side >= 0")


def _samples(terms: DataFrame, by: list[str], samples: int) -> DataFrame:
    """The least ln a of every sample over the terms (h, w) of each key.

    r and c are gamma (2, 1) and beta is uniform, all from hashes of the term: t = floor(ln w / r + beta),
    ln y = r (t - beta), a = c / (y e^r). Two texts have one least a if and only if one term is least in both
    with the same t, the chance of which is the generalised Jaccard similarity of their weights.
    """
    unit = lambda bits: (bits.cast("double") + 0.5) * (1.0 / (1 << 32))
    high, low = lambda z: unit(F.shiftrightunsigned(z, 32)), lambda z: unit(z.bitwiseAND(F.lit((1 << 32) - 1)))
    gamma = lambda z: -F.ln(high(z) * low(z))

    def a(k: int) -> Column:
        x = F.xxhash64(F.col("h"), F.lit(k))
        y = F.xxhash64(x, F.lit(1))
        r, c, beta = gamma(x), gamma(y), high(F.xxhash64(y, F.lit(2)))
        return F.ln(c) - r * (F.floor(F.col("v") / r + beta) - beta + 1.0)

    # each sample is an aggregate of its own, whose code Spark splits off: one method for all isn't compiled
    return terms.select(*by, "h", F.ln("w").alias("v")).groupBy(*by).agg(*[F.min(a(k)).alias(f"s{k}") for k in range(samples)])


def _digits(samples: Column) -> Column:
    """16 bits of each sample in hexadecimal, one after another."""
    return F.array_join(F.transform(samples, lambda x: F.when(x.isNull(), F.lit(NOTHING)).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(65535)))), 4, "0"))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints; two without terms are alike (1), one without is like no other (0)."""
    part = lambda x, k: F.substr(x, 4 * k + 1, F.lit(4))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: part(a, k) == part(b, k))) / F.lit(float(samples))


def _followed(rows: DataFrame) -> DataFrame:
    """For each doc_id the next one (after the last the first), by ranges of ids; written.

    Rows are (id, none) as null doc_ids come last, with n, the most characters of its rows, and th, the
    least text hash of them: the row that stands for the id.
    """
    ids = rows.groupBy("none", "id").agg(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("th"))
    parts = written(ids.repartitionByRange("none", "id").withColumn("part", F.spark_partition_id()), "print-ids")
    key, heads = F.struct("none", "id"), W.orderBy("part")
    first = parts.groupBy("part").agg(F.min(key).alias("head"))  # a row per partition
    ahead = first.select("part", F.coalesce(F.lead("head").over(heads), F.first("head").over(heads)).alias("head"))
    inside = parts.withColumn("next", F.lead(key).over(W.partitionBy("part").orderBy("none", "id")))
    links = inside.join(ahead, "part").select("none", "id", "n", "th", F.coalesce("next", "head").alias("next"))
    out = written(links.select("none", "id", "n", "th", F.col("next.none").alias("next_none"), F.col("next.id").alias("next_id")), "print-links")
    dropped(parts)
    return out


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs(doc_id, text)``.

    A text's terms (runs without white space, in pieces of 16 characters at most) weigh as often as they
    occur. The edited text has its last quarter of code points replaced by the first as many of the next
    document's. Next is the next greater doc_id, after the last the first; of rows with one doc_id the one
    with the least text hash stands for it, and null doc_ids are one id after all others. Each document
    sends the piece that its predecessor needs, so texts move once.

    Null texts are empty; texts without terms have one fingerprint of their own, like each other (1) and
    unlike all others (0). Repeated rows come out again each; a single document is its own next one; an empty
    table gives no row; texts of any length are read whole; other columns aren't read.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    links = _followed(rows)
    key = ["id", "none"]
    before = links.select(F.col("next_id").alias("id"), F.col("next_none").alias("none"), F.col("id").alias("to_id"), F.col("none").alias("to_none"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    needs = written(links.select(*key, F.col("th").alias("first")).join(before, key), "print-needs")
    same = lambda th: th.bitwiseXOR(F.col("first")) == 0  # noqa: E731  (no key of the join: texts keep one partitioning)
    given = rows.join(needs, key).filter(same(F.xxhash64("text")))
    given = given.select(F.col("to_id").alias("id"), F.col("to_none").alias("none"), F.col("id").alias("next_id"), F.col("none").alias("next_none"), F.substr("text", F.lit(1), F.col("need")).alias("gift")).dropDuplicates(key)
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr(F.coalesce("gift", F.lit("")), F.lit(1), quarter))
    both = rows.join(given, key, "left").select(*key, F.xxhash64("text").alias("th"), n.cast("long").alias("n_chars"), "next_id", "next_none", "text", edited.alias("edited"))
    own = [*key, "th", "n_chars", "next_id", "next_none", "edited_sha256"]
    terms = _terms(both.select(*own[:-1], F.sha2("edited", 256).alias("edited_sha256"), "text", "edited"), own)
    least = _samples(terms, [*own, "side"], samples)
    parts = least.select(*own, "side", F.array(*[f"s{k}" for k in range(samples)]).alias("s")).groupBy(*own).agg(F.collect_list(F.struct("side", "s")).alias("parts"))

    def of(side: int) -> Column:
        held = F.transform(F.filter("parts", lambda p: p["side"] != 1 - side), lambda p: p["s"])
        return _digits(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.array_min(F.transform(held, lambda s: F.get(s, k)))))

    prints = written(parts.select(*own, of(0).alias("fingerprint"), of(1).alias("edited_fingerprint")), "prints")
    # rows meet the next document's fingerprint; repeated rows, once in ``prints``, come back as often as they were
    ahead = prints.select(*key, "th", "fingerprint").join(needs.select(*key, "first"), key).filter(same(F.col("th"))).select(F.col("id").alias("next_id"), F.col("none").alias("next_none"), F.col("fingerprint").alias("ahead"))
    again = rows.groupBy(*key, F.xxhash64("text").alias("th")).agg(F.count("*").alias("m")).filter("m > 1").groupBy(*key).agg(F.collect_list(F.struct("th", "m")).alias("again"))
    copies = F.coalesce(F.get(F.filter("again", lambda x: x["th"] == F.col("th")), F.lit(0))["m"], F.lit(1))
    out = prints.join(ahead, ["next_id", "next_none"]).join(again, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("ahead"), samples).alias("near_next"),
    )
