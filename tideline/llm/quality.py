"""Quality rules whose thresholds adapt to each language and source by mergeable quantile sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORD, dropped, small, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Counts whose rates are judged: count -> what it is a share of.
RATES = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "mean_word_chars": ("word_chars", "n_words"), "stutter_ratio": ("n_stutter", "n_words")}
#: A rate's fences stand so many interquartile ranges beyond its quartiles, on a logarithmic scale (a mean over
#: few words strays more than a share).
SPREAD = {"symbol_ratio": 3.0, "dup_line_ratio": 3.0, "mean_word_chars": 4.0, "stutter_ratio": 3.0}
#: Rows that a group's own fences weigh as much as those of the group above it (its language, then all).
SHRINK = 100.0
SKETCH_K = 400


def _let(value: Column, use) -> Column:
    """Binds ``value`` to a lambda variable, so that an array that ``use`` names often is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words within 5-word windows that occur twice or more: sorts the windows, then sums covered words."""
    at = lambda a, i: F.get(a, i)
    windows = F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - 4), lambda h, i: F.xxhash64(h, *[at(hashes, i + k) for k in range(1, 5)]))

    def covered(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def hit(pair: Column) -> Column:
            same = F.filter(pair, lambda x, i: x["h"].eqNullSafe(at(pair, i - 1)["h"]) | x["h"].eqNullSafe(at(pair, i + 1)["h"]))
            start = F.sort_array(F.transform(same, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            add = lambda s, i: F.struct((s["n"] + i + 5 - F.greatest(i, s["end"])).cast("long").alias("n"), (i + 5).alias("end"))
            return F.aggregate(start, zero, add, lambda s: s["n"])

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(_let(pairs, hit))

    return F.when(F.size(hashes) < 6, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, base_failed and the ratios; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        stutter = lambda h: F.size(F.filter(h, lambda x, i: x.eqNullSafe(F.get(h, i - 1))))
        return _let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeated(h).alias("n_repeat_words"), stutter(h).cast("long").alias("n_stutter")))

    return (
        docs.withColumn("_quality_words", _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words))
        .withColumn("_quality_lines", _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))))
        .withColumn("n_words", F.col("_quality_words.n_words"))
        .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", F.col("_quality_lines.dup").cast("long"))
        .withColumn("n_repeat_words", F.col("_quality_words.n_repeat_words"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("n_lines", F.col("_quality_lines.n").cast("long"))
        .withColumn("n_stutter", F.col("_quality_words.n_stutter"))
        .drop("_quality_words", "_quality_lines")
    )


def smoothed(rate: str) -> Column:
    """Logarithm of a rate with half a hit more: rows without a hit differ by their length, so quartiles are never all equal."""
    hits, of = RATES[rate]
    return F.log((F.col(hits) + 0.5) / (F.col(of) + 1.0))


def thresholds(rows: DataFrame) -> DataFrame:
    """Per (lang, source) and rate the fences (low, high), on the logarithmic scale, from KLL sketches of rows past the base rules.

    Sketches are built once per (lang, source) and merged into those of languages and of all rows. A group's
    quartiles q1 and q3 give q1 - SPREAD x (q3 - q1) and q3 + SPREAD x (q3 - q1); with n rows they weigh
    n / (n + SHRINK), and those of the group above it the rest, so thresholds of groups of any size come
    from their own rows as far as these carry.
    """
    passed = rows.filter(~F.col("base_failed"))
    fine = written(passed.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(smoothed(r), SKETCH_K).alias(r) for r in RATES]), "quality-sketches")

    def fences(table: DataFrame, name: str, *by: Column) -> DataFrame:
        def of(r: str) -> Column:
            low, high = (F.kll_sketch_get_quantile_double(F.col(r), F.lit(p)) for p in (0.25, 0.75))
            return F.struct((low - SPREAD[r] * (high - low)).alias("low"), (high + SPREAD[r] * (high - low)).alias("high")).alias(r)

        return table.select(*by, F.struct("n", *[of(r) for r in RATES]).alias(name))

    merged = lambda *by: fine.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, SKETCH_K).alias(r) for r in RATES])
    own = fences(fine, "own", F.col("lang").alias("_quality_lang"), F.col("source").alias("_quality_source"))
    by_lang = fences(merged("lang"), "by_lang", F.col("lang").alias("l"))
    by_all = fences(merged(F.lit(0).alias("one")), "by_all")
    joined = own.join(small(written(by_lang, "quality-languages")), F.col("_quality_lang").eqNullSafe(F.col("l")), "left").crossJoin(F.broadcast(by_all))  # by_all: one row

    def shrunk(r: str, end: str) -> Column:
        mean = lambda g, above: (F.col(f"{g}.n") * F.col(f"{g}.{r}.{end}") + SHRINK * above) / (F.col(f"{g}.n") + SHRINK)
        return mean("own", mean("by_lang", F.col(f"by_all.{r}.{end}"))).alias(end)

    limits = [F.struct(shrunk(r, "low"), shrunk(r, "high")).alias(r) for r in RATES]
    out = written(joined.select("_quality_lang", "_quality_source", F.struct(*limits).alias("_quality_limits")), "quality-limits")
    dropped(fine)
    return out


def judge_quality(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` with the base counts, base_failed and kept.

    A document is kept if it passes the base rules and none of its rates (symbols per word character,
    repeated lines per line, words equal to the one before per word) is above the upper fence of its
    language and source, and its characters per word are between the fences. A rate without a hit exceeds
    nothing. Null text has no words (the base rules drop it, like an empty one); very long texts are read
    whole; null language or source is a group like any other; an empty table gives no rows; rows that
    repeat are judged each. Columns of ``docs`` named like an output are replaced. ``keep`` names
    the columns of ``docs`` to return (default: all); without the text the written table is small.
    """
    own = [c for c in docs.columns if keep is None or c in keep or c in ("lang", "source")]
    scored = measured(docs)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "base_failed"]
    rows = written(scored.select(*[c for c in own if c not in made], *made), "quality-rows")
    limits = small(thresholds(rows))
    fence = lambda r, end: F.col(f"_quality_limits.{r}.{end}")
    exceeds = smoothed("mean_word_chars") < fence("mean_word_chars", "low")
    for r, (hits, of) in RATES.items():
        exceeds = exceeds | ((F.col(hits) > 0) & (F.log(F.col(hits) / F.greatest(of, F.lit(1))) > fence(r, "high")))
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("_quality_lang")) & F.col("source").eqNullSafe(F.col("_quality_source")), "left")
    gone = [c for c in ("lang", "source") if keep is not None and c not in keep]
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(exceeds, F.lit(False))).drop("_quality_lang", "_quality_source", "_quality_limits", *gone)
