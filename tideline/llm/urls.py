"""URL filters: longest-suffix rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hash buckets of the model, lengths of its n-grams, and passes of its training.
DIM, GRAMS, EPOCHS, RATE, DECAY = 4096, (3, 4), 20, 0.5, 2e-4
#: Labelled rows of one step.
BATCH = 32
#: Labelled rows that training takes at most: it is a fold over a small table by one task.
MOST_LABELLED = 5_000
#: Words of hosts and paths that our own labels block, and words that they allow.
BAD = (
    "casino casinos slots roulette jackpot poker blackjack baccarat bingo betting sportsbet freebet bets wager gamble lotto lottery viagra cialis levitra pills pharma cheapmeds steroid "
    "porn porno xxx sex sexcam webcams nude nudes erotic escort escorts hookup milf fetish adult onlysex replica knockoff payday quickloan fastcash getrich freemoney winprize giveaway sweepstake "
    "warez crackz keygen serialz torrentz hacked phish verify-account login-secure click adclick adserver popunder tracker trackpixel doubleads spam spammer seolinks backlinks linkfarm clickfarm botfarm malware "
    "ransom dropship miracle-diet weightloss forex-signals binary-options pump-coin airdrop"
).split()
GOOD = (
    "library museum archive university college school kinder science physics chemistry biology history geography language grammar dictionary encyclopedia wiki journal research paper thesis lecture course "
    "weather climate garden flower forest river mountain ocean animal bird cooking recipe kitchen bread travel hotel railway airport city council parliament ministry court law health hospital clinic nurse "
    "news daily press radio theatre music concert painting gallery poetry novel book reader film photo design architecture engineer software docs manual developer opensource linux python forum blog "
    "sport football tennis chess cycling family parents charity church market bakery coffee"
).split()
#: Shapes of the labelled urls; every word of either kind is put into the same number of each.
SHAPES = (
    "https://{w}.com/", "http://www.{w}-{s}.net/{p}/{n}", "https://{s}{w}.org/{p}", "http://{w}{n}.info/{p}.html", "https://{s}.io/{w}/{n}/", "http://{s}.co.uk/{p}/{w}-{n}.html",
    "https://m.{w}.{s}.de/{p}/{n}?page=2", "https://{w}-{p}.{s}.fr/{n}", "http://blog.{s}.eu/{p}/{w}", "https://{s}-{w}.biz/index.php#{n}",
)
#: Neutral words of hosts and paths (made of syllables), and how many shapes each word is put into.
SYLLABLES, PATHS, SHAPES_A_WORD, NEUTRAL = "an ba cor del en fi gra hal in jo kel lum mer nor ol per qua ri sol ta un ver wil zan th ing ti on es".split(), "a c en de fr es item page post view news id 2021".split(), 8, 900


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, each part marked by its first character; linear in the url's length."""

    def of(text: Column, n: int) -> Column:
        # positions are read from an array of characters: a substring would count from the start each time
        cut = lambda c: F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, *[F.get(c, i + k) for k in range(1, n)]), F.lit(DIM)).cast("int"))
        return F.get(F.transform(F.array(F.split(text, "")), cut), F.lit(0))

    parts = (F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit(">"), F.translate(path, "0123456789", "0000000000")))
    return F.concat(*[of(p, n) for p in parts for n in GRAMS])


def labelled_rows(seed: int = 7) -> list[tuple[str, int]]:
    """The labelled table as (url, 1: block): words of both kinds in shapes that say nothing about the label, and
    hosts of syllables alone, which are allowed."""
    luck = random.Random(seed)
    name = lambda: "".join(luck.choice(SYLLABLES) for _ in range(luck.randrange(2, 4)))
    fill = lambda shape, w: shape.format(w=w, s=name(), p=luck.choice(PATHS), n=luck.randrange(1, 9999))
    rows = [(fill(luck.choice(SHAPES), w), y) for y, words in ((1, BAD), (0, GOOD)) for w in words for _ in range(SHAPES_A_WORD)]
    return rows + [(fill(luck.choice(SHAPES), name()), 0) for _ in range(NEUTRAL)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: block)."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def train(labelled: DataFrame) -> list[float]:
    """Weights by stochastic gradient descent, as one fold over batches of labelled rows in Spark SQL.

    The labelled table is small (MOST_LABELLED rows at most, else ValueError): its rows, in an order by hash,
    make batches of BATCH, and the fold passes EPOCHS times over these. A batch holds its rows' n-grams and,
    for each bucket, the rows that have it, so that both a margin and a step read only what is there. The
    last weight is the bias. Rows with a null url or label are left out; without rows all weights are 0.
    """
    if labelled.count() > MOST_LABELLED:
        raise ValueError(f"url filters learn from {MOST_LABELLED} labelled rows at most")
    url = F.col("url")
    known = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("double").alias("y"), grams(host_of(url), path_of(url)).alias("x"))
    turn = F.row_number().over(W.orderBy(F.xxhash64("url"), "url", "y")) - 1  # MOST_LABELLED rows at most
    rows = known.withColumn("turn", turn).select(F.floor(F.col("turn") / BATCH).alias("b"), (F.col("turn") % BATCH).cast("int").alias("k"), "y", "x", F.sqrt(F.greatest(F.size("x"), F.lit(1))).alias("norm"))
    having = rows.select("b", "k", (1 / F.col("norm")).alias("v"), F.explode("x").alias("i")).groupBy("b", "i").agg(F.collect_list(F.struct("k", "v")).alias("rows"))
    buckets = rows.select("b").distinct().select("b", F.explode(F.sequence(F.lit(0), F.lit(DIM - 1))).alias("i"))
    by_bucket = buckets.join(having, ["b", "i"], "left").groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rows"))), lambda e: e["rows"]).alias("having"))
    batches = rows.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("k", "y", "x", "norm"))).alias("rows")).join(by_bucket, "b")
    table = batches.agg(F.array_sort(F.collect_list(F.struct("b", "rows", "having"))).alias("batches"))

    def step(w: Column, batch: Column) -> Column:
        margin = lambda r: F.aggregate(r["x"], F.get(w, F.lit(DIM)), lambda s, i: s + F.get(w, i) / r["norm"])
        errors = F.transform(batch["rows"], lambda r: (r["y"] - 1 / (1 + F.exp(-margin(r)))) * RATE)

        def moved(e: Column) -> Column:
            gain = lambda i: F.coalesce(F.aggregate(F.get(batch["having"], i), F.lit(0.0), lambda s, r: s + F.get(e, r["k"]) * r["v"]), F.lit(0.0))
            return F.transform(w, lambda v, i: v * (1 - DECAY) + F.when(i == DIM, F.aggregate(e, F.lit(0.0), lambda s, x: s + x)).otherwise(gain(i)))

        return F.get(F.transform(F.array(errors), moved), F.lit(0))

    zero = F.array_repeat(F.lit(0.0), DIM + 1)
    epochs = F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), zero, lambda w, _: F.aggregate("batches", w, step))
    return list(table.select(epochs.alias("w")).first()["w"])


def judge_urls(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, cutoff: float = 0.5) -> DataFrame:
    """``pages(page_id, url, ...)``: page_id, host, path, rule, verdict, score.

    Null urls and urls without ``://`` have an empty host and path, fit no rule, and get the model's
    verdict (its bias). score is the model's chance of ``block``; a rule's verdict overrides it. Urls of
    any length are read whole, in linear time; rows that repeat are judged each; an empty table gives no
    rows; other columns of ``pages`` aren't read, whatever their names. Rules of one length: the later wins.
    """
    weights = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    w = F.lit(weights)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    margin = F.get(F.transform(F.array(grams(F.col("host"), F.col("path"))), lambda g: F.aggregate(g, F.lit(weights[DIM]), lambda s, i: s + F.get(w, i) / F.sqrt(F.greatest(F.size(g), F.lit(1))))), F.lit(0))
    score = 1 / (1 + F.exp(-margin))
    return parts.withColumn("score", score).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") >= cutoff, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
