"""Sharding by balanced label propagation: linked documents gather in shards of equal counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tideline.llm.common import dropped, written

#: Rows of one (shard, bucket) cell that a single task numbers.
BUCKET_ROWS = 1024


def balance_shards(docs: DataFrame, shards: int = 16, rounds: list | None = None) -> DataFrame:
    """Assigns every row of ``docs(doc_id, text, ...)`` to a shard; shard counts differ by one at most.

    Links join rows of equal text. Labels start from a hash and propagate: in each round every linked row looks
    at the shards that its neighbours are in now and wishes for the one with most of them, among those that come
    before its own and have room; shards admit rows, many together first, within their quotas, and what leaves
    makes room. Rounds end when the cut edges fall no more. Groups that are still cut then gather whole in a shard
    with room for all of them, as long as one fits; groups of a sixteenth of a quota or more do so before the
    rounds. Only a group larger than a shard's quota is cut, at the quota. Rows without links are the filler: at
    the end, rows beyond a shard's quota, unlinked ones first, move to shards that lack rows. ``rounds`` is
    given the cut edges before each round.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ('rows'), shard, slot (0.. without gaps in
    each shard), grown_shard (null). Null texts have size 1, checksum 0 and are linked with one another
    apart from empty texts. Repeated rows are rows of their own. An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text, F.md5(F.encode(text, "UTF-8")), text.isNull()).alias("text_key"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("text_key").agg(F.count("*").alias("members"))
    n = rows.count()
    quota = max(1, n // shards)
    linked = written(groups.filter("members > 1"), "shard-groups")
    start = F.pmod(F.xxhash64("doc_id", "uid"), F.lit(shards)).cast("int")
    placed = written(
        _parts(rows, linked, quota).join(linked, "text_key", "left").select(
            "doc_id", "size", "text_crc32", "uid", start.alias("start"), F.col("members").isNotNull().alias("linked"), F.xxhash64("text_key", "part").alias("unit"),
        ),
        "shard-placed",
    )
    dropped(rows)
    cells = written(placed.filter("linked").groupBy("unit", "start").agg(F.count("*").alias("n")), "shard-cells")
    moved = _moved(cells, quota, shards, [] if rounds is None else rounds)
    labelled = placed.join(moved, ["unit", "start"], "left").withColumn("shard", F.coalesce("moved", "start"))
    return _even(labelled, n, shards, (placed, cells, linked, moved))


def _parts(rows: DataFrame, linked: DataFrame, quota: int) -> DataFrame:
    """``rows`` with part: groups over the quota are numbered and cut at it, by buckets of rows; others are part 0."""
    large = {r["text_key"]: r["members"] for r in linked.filter(F.col("members") > quota).collect()}  # fewer than shards
    if not large:
        return rows.withColumn("part", F.lit(0).cast("long"))
    buckets = F.create_map(*[F.lit(x) for k, m in large.items() for x in (k, -(-m // BUCKET_ROWS))])
    own = F.col("text_key").isin(list(large))
    dealt = rows.filter(own).withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(7)), buckets[F.col("text_key")]))
    counts = dealt.groupBy("text_key", "bucket").agg(F.count("*").alias("n"))
    heads = counts.select("text_key", "bucket", (F.sum("n").over(W.partitionBy("text_key").orderBy("bucket")) - F.col("n")).alias("head"))
    at = F.row_number().over(W.partitionBy("text_key", "bucket").orderBy("uid")) - 1
    cut = dealt.withColumn("at", at).join(heads, ["text_key", "bucket"]).withColumn("part", F.floor((F.col("head") + F.col("at")) / quota).cast("long"))
    return rows.filter(~own).withColumn("part", F.lit(0).cast("long")).unionByName(cut.drop("bucket", "at", "head"))


def _moved(cells: DataFrame, quota: int, shards: int, rounds: list) -> DataFrame:
    """unit, start, moved: the shard of the rows of each cell (a unit's rows of one start).

    Units of a sixteenth of a shard or more are few: the driver places them, the largest first. The others propagate
    in the room that is left, and those that are cut after it are settled whole.
    """
    spark, room, large = cells.sparkSession, [quota] * shards, []
    sizes = cells.groupBy("unit").agg(F.sum("n").alias("total"))
    held = F.expr("transform(sort_array(collect_list(struct(n, -start as s)), false), x -> -x.s)")
    for r in sorted(cells.join(sizes.filter(F.col("total") * 16 >= quota), "unit").groupBy("unit").agg(F.first("total").alias("total"), held.alias("held")).collect(), key=lambda r: (-r["total"], r["unit"])):  # 16 x shards at most
        order = [*r["held"], *(x for x in range(shards) if x not in r["held"])]
        if (to := next((x for x in order if room[x] >= r["total"]), None)) is not None:
            room[to] -= r["total"]
            large.append((r["unit"], to))
    seeded = spark.createDataFrame(large, "unit long, moved int")
    state = _propagated(written(cells.join(F.broadcast(seeded), "unit", "left_anti").withColumn("shard", F.col("start")), "shard-state"), list(room), shards, rounds)
    votes = state.groupBy("unit").agg(F.sum("n").alias("total"), F.count_distinct("shard").alias("held"), F.first("shard").alias("shard"))
    for r in votes.filter("held = 1").groupBy("shard").agg(F.sum("total").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    settled = _settled(state.join(votes.filter("held > 1").select("unit"), "unit", "left_semi").groupBy("unit", "shard").agg(F.sum("n").alias("n")), room, shards)
    kept = state.join(settled, "unit", "left").select("unit", "start", F.coalesce("moved", "shard").alias("moved"))
    out = written(kept.unionByName(cells.select("unit", "start").join(F.broadcast(seeded), "unit")), "shard-moved")
    dropped(state, settled)
    return out


def _propagated(state: DataFrame, room: list[int], shards: int, rounds: list) -> DataFrame:
    """``state(unit, start, n, shard)`` after the rounds of propagation; ``rounds`` gets the cut edges before each.

    A row's neighbours are its unit's rows, so their votes are a count per unit and shard, which is joined back in
    each round. Requests are summed by (from, to, size class, hash); the driver sees these sums only. Rows move up
    in their unit's order of shards, so linked rows never swap places.
    """
    for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        room[r["shard"]] -= r["n"]
    while True:
        votes = state.groupBy("unit", "shard").agg(F.sum("n").alias("n"))
        rank = F.struct("n", F.pmod(F.xxhash64("unit", "shard"), F.lit(1 << 20)).alias("luck"), "shard")
        order = votes.groupBy("unit").agg(F.sort_array(F.collect_list(rank), asc=False).alias("order"))  # a shard each at most
        edges = F.expr("(pow(aggregate(order, 0L, (s, x) -> s + x.n), 2) - aggregate(order, 0.0D, (s, x) -> s + pow(x.n, 2))) / 2")
        rooms = "array(" + ",".join(f"{x}L" for x in room) + ")"
        before = "slice(order.shard, 1, cast(array_position(order.shard, shard) - 1 as int))"
        asked = state.join(order, "unit").withColumn("want", F.expr(f"get(filter({before}, s -> {rooms}[s] >= n), 0)"))
        asked = written(asked.select("unit", "start", "n", "shard", "want", F.floor(F.log2("n")).alias("class"), F.pmod(F.xxhash64("unit", F.lit(len(rounds))), F.lit(32)).alias("luck"), F.when(F.row_number().over(W.partitionBy("unit").orderBy("start")) == 1, edges).alias("cut")), "shard-asked")
        dropped(state)
        rounds.append(int(asked.agg(F.sum("cut")).first()[0] or 0))
        key = ["want", "shard", "class", "luck"]
        sums = asked.filter("want is not null").groupBy(*key).agg(F.sum("n").alias("n")).collect()
        admitted = _admitted(sums, key, room, leaves=True)
        if not admitted or (len(rounds) > 1 and rounds[-1] >= rounds[-2]):
            return asked
        yes = F.broadcast(asked.sparkSession.createDataFrame([(*a, True) for a in admitted], "want int, shard int, class long, luck int, yes boolean"))  # shards^2 x classes x 32 at most
        state = written(asked.join(yes, key, "left").select("unit", "start", "n", F.when(F.col("yes"), F.col("want")).otherwise(F.col("shard")).alias("shard")), "shard-state")
        dropped(asked)


def _settled(cells: DataFrame, room: list[int], shards: int) -> DataFrame:
    """unit, moved: the shard of each unit of ``cells(unit, shard, n)`` that fits whole into one.

    Requests are summed by (shard, size class, hash) and admitted on the driver while they fit; where no sum
    fits, single units of a bounded number of requests do, so each round with a request admits one at least.
    """
    spark, k, done = cells.sparkSession, 0, []
    held = F.sort_array(F.collect_list(F.struct("n", (-F.col("shard")).alias("s"))), asc=False)
    turn = f"pmod(xxhash64(unit), {shards})"
    units = cells.groupBy("unit").agg(F.sum("n").alias("total"), held.alias("held")).withColumn("first", F.expr("transform(held, x -> -x.s)"))
    rest = f"filter(transform(sequence(0, {shards - 1}), x -> cast(pmod(x + {turn}, {shards}) as int)), x -> not array_contains(first, x))"
    pending = written(units.select("unit", "total", F.expr(f"concat(first, {rest})").alias("prefs")), "shard-units")
    while True:
        rooms = "array(" + ",".join(f"{x}L" for x in room) + ")"
        want = pending.withColumn("want", F.expr(f"get(filter(prefs, s -> {rooms}[s] >= total), 0)")).filter("want is not null")
        asked = written(want.withColumn("class", F.floor(F.log2("total"))).withColumn("luck", F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(256))), "shard-asked")
        dropped(pending)
        key, sums = ["want", "class", "luck"], asked.groupBy("want", "class", "luck").agg(F.sum("total").alias("n")).collect()
        if not sums:
            dropped(asked)
            break
        admitted = _admitted(sums, key, room)
        if not admitted:
            key = ["want", "unit"]
            admitted = _admitted(asked.select("want", "unit", "class", F.lit(0).alias("luck"), F.col("total").alias("n")).limit(10_000).collect(), key, room)
        types = {"want": "int", "class": "long", "luck": "long", "unit": "long"}
        yes = F.broadcast(spark.createDataFrame(admitted, ", ".join(f"{c} {types[c]}" for c in key)))  # sums or 10,000 rows at most
        done.append(written(asked.join(yes, key, "left_semi").select("unit", F.col("want").alias("moved")), "shard-settled"))
        pending = written(asked.join(yes, key, "left_anti").select("unit", "total", "prefs"), "shard-units")
        dropped(asked)
        k += 1
    out = written(reduce(DataFrame.unionByName, done, spark.createDataFrame([], "unit long, moved int")), "shard-settled")
    dropped(*done)
    return out


def _admitted(asks: list, key: list[str], room: list[int], leaves: bool = False) -> list[tuple]:
    """Keys of the requests that fit, large classes first; takes their rows from ``room`` (and frees it where they leave)."""
    out = []
    for r in sorted(asks, key=lambda r: (-r["class"], r["luck"], *(r[c] for c in key))):
        if r["n"] <= room[r["want"]]:
            room[r["want"]] -= r["n"]
            if leaves:
                room[r["shard"]] += r["n"]
            out.append(tuple(r[c] for c in key))
    return out


def _even(labelled: DataFrame, n: int, shards: int, used: tuple) -> DataFrame:
    """Numbers the rows of each shard and moves what is over its quota, unlinked rows first."""
    buckets = max(1, -(-n // (shards * BUCKET_ROWS)))
    late = F.when(F.col("linked"), 0).otherwise(buckets)
    ranked = written(
        labelled.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(buckets)).cast("int") + late)
        .withColumn("at", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "uid")) - 1)
        .select("doc_id", "size", "text_crc32", "shard", "bucket", "at"),
        "shard-ranked",
    )
    dropped(*used)
    counts = ranked.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    heads = counts.withColumn("head", F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    slotted = ranked.join(heads.select("shard", "bucket", F.coalesce("head", F.lit(0)).alias("head")), ["shard", "bucket"]).withColumn("slot", F.col("head") + F.col("at"))
    totals = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    over = [max(0, totals.get(s, 0) - quota[s]) for s in range(shards)]
    lack = [max(0, quota[s] - totals.get(s, 0)) for s in range(shards)]
    sql = lambda values: "array(" + ",".join(f"{v}L" for v in values) + ")"
    sums = lambda values: [sum(values[:k]) for k in range(len(values))]
    turn = F.expr(f"{sql(sums(over))}[shard] + slot - {sql(quota)}[shard]")  # number among all rows that move
    goes = F.col("slot") >= F.expr(f"{sql(quota)}[shard]")
    cases = F.expr(f"size(filter({sql(sums(lack))}, (x, i) -> x <= turn and {sql(lack)}[i] > 0)) - 1")
    filled = [s for s in range(shards) if lack[s]]
    to = F.expr(f"{sql(filled or [0])}[pick]")
    moved = slotted.withColumn("turn", F.when(goes, turn)).withColumn("pick", F.when(goes, cases)).withColumn("to", F.when(goes, to))
    kept = [min(totals.get(s, 0), quota[s]) for s in range(shards)]
    return moved.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce("to", "shard").cast("int").alias("shard"),
        F.when(goes, F.expr(f"{sql(kept)}[to] + turn - {sql(sums(lack))}[to]")).otherwise(F.col("slot")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
