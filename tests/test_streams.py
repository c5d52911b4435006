"""Streams that run to their end against brute force, restarts and lists that change between batches."""

import datetime
import json
import os
import random

import pytest

from tideline.streaming import live as L


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def feed(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/feed/part={k}")


@pytest.fixture
def store(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_alerts_once_in_24_hours(spark, tmp_path, store):
    """Two runs over a growing feed: what is sent is what the rule says of all rows in order, also around midnight."""
    rng = random.Random(2)
    rows = [(rng.choice("abcd"), at(rng.randrange(0, 10 * 86_400))) for _ in range(400)] + [("x", at(86_399)), ("x", at(86_401)), ("x", at(2 * 86_400 + 5)), ("x", None)]
    half = at(5 * 86_400)
    want, last = [], {}
    for key, ts in sorted(r for r in rows if r[1]):
        if key not in last or (ts - last[key]).total_seconds() >= 86_400:
            want.append((key, ts))
            last[key] = ts
    schema = "key string, ts timestamp"
    for k, part in enumerate(([r for r in rows if not r[1] or r[1] < half], [r for r in rows if r[1] and r[1] >= half])):
        feed(spark, tmp_path, k, part, schema)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/feed/part=*")
        q = L.alerts_once(stream).writeStream.format("parquet").option("path", f"{tmp_path}/sent").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    got = sorted((r.key, r.ts) for r in spark.read.parquet(f"{tmp_path}/sent").collect())
    assert got == sorted(want)


def test_alert_state_is_kept_by_buckets(spark, tmp_path, store):
    """Many keys cost few visits to the state store; windows end to the microsecond, also those begun in a run before."""
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(2000)}", at(rng.randrange(0, 3 * 86_400))) for _ in range(6000)]
    tiny = datetime.timedelta(microseconds=1)
    rows += [("x", at(0) + 501 * tiny), ("x", at(86_400) + 500 * tiny), ("x", at(86_400) + 501 * tiny), (None, at(5)), (None, at(6))]
    rows += [("y", at(80_000)), ("y", at(166_399)), ("y", at(166_400))]
    want, last = [], {}
    for key, ts in sorted(rows, key=lambda r: r[1]):
        if key not in last or ts - last[key] >= datetime.timedelta(days=1):
            want.append((key, ts))
            last[key] = ts
    schema, half, held = "key string, ts timestamp", at(86_400) + 400 * tiny, 0
    for k, part in enumerate(([r for r in rows if r[1] < half], [r for r in rows if r[1] >= half])):
        feed(spark, tmp_path, k, part, schema)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/feed/part=*")
        q = L.alerts_once(stream, buckets=8).writeStream.format("parquet").option("path", f"{tmp_path}/sent").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        held = max([held, *(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])])
    got = [(r.key, r.ts) for r in spark.read.parquet(f"{tmp_path}/sent").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert held <= 4 * 8  # a bucket's value and its timer, not a row per key


def test_prices_are_pushed_once_and_dead_receivers_dropped(spark, tmp_path):
    for n in ("one", "two"):
        os.makedirs(tmp_path / n)
    receivers = [str(tmp_path / n) for n in ("one", "gone", "two")]
    schema = "ticker string, price double, ts timestamp"

    def run(k, rows, checkpoint="log"):
        if rows:
            feed(spark, tmp_path, k, rows, schema)
        q = L.push_prices(spark.readStream.schema(schema).parquet(f"{tmp_path}/feed/part=*"), str(tmp_path / "sent"), receivers, str(tmp_path / checkpoint))
        q.awaitTermination()
        assert q.exception() is None

    run(0, [("A", 1.0, at(1)), ("A", 2.0, at(2)), ("B", 5.0, at(1)), ("C", None, at(3))])
    first = json.loads((tmp_path / "one" / "0.json").read_text())
    assert first == {"epoch": 0, "prices": [{"ticker": "A", "price": 2.0}, {"ticker": "B", "price": 5.0}]}
    assert (tmp_path / "sent" / "dead-gone").exists()
    os.makedirs(tmp_path / "gone")  # it is back, but was dropped
    run(1, [("A", 3.0, at(9))])
    assert sorted(p.name for p in (tmp_path / "two").iterdir()) == ["0.json", "1.json"] and not list((tmp_path / "gone").iterdir())
    before = (tmp_path / "one" / "0.json").stat().st_mtime_ns
    run(2, [], "lost")  # started anew without its checkpoint: epoch 0 comes again and isn't sent again
    assert (tmp_path / "one" / "0.json").stat().st_mtime_ns == before


def test_watchlist_changes_between_batches(spark, tmp_path):
    schema, lists = "ticker string, price double, ts timestamp", "version long, ticker string"

    def run(k, rows):
        feed(spark, tmp_path, k, rows, schema)
        q = L.start_watched(spark.readStream.schema(schema).parquet(f"{tmp_path}/feed/part=*"), f"{tmp_path}/list", f"{tmp_path}/latest", f"{tmp_path}/log")
        q.awaitTermination()
        assert q.exception() is None
        return {r.ticker: r.price for r in spark.read.parquet(f"{tmp_path}/latest/v{k}").collect()}

    spark.createDataFrame([(0, "A"), (0, "B")], lists).write.parquet(f"{tmp_path}/list")
    assert run(0, [("A", 1.0, at(1)), ("B", 1.0, at(1)), ("C", 1.0, at(1))]) == {"A": 1.0, "B": 1.0}
    spark.createDataFrame([(1, "B"), (1, "C")], lists).write.mode("append").parquet(f"{tmp_path}/list")  # A leaves, C joins
    assert run(1, [("A", 2.0, at(2)), ("B", 2.0, at(2)), ("C", 2.0, at(2))]) == {"A": 1.0, "B": 2.0, "C": 2.0}


def test_push_takes_batches_and_events_are_dealt_by_many_tasks(spark, tmp_path):
    """A task's last price per ticker comes from Arrow batches; an epoch's events are written by as many tasks as read them."""
    import pyarrow as pa

    from tideline.plans import markets

    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("ticker", "price", "ts"), r)) for r in rows], pa.schema({"ticker": pa.string(), "price": pa.float64(), "ts": pa.timestamp("us", "UTC")}))
    push = L._Push({"log": str(tmp_path), "receivers": ""})
    sent = push.write(iter([batch(("A", 1.0, at(5)), ("A", 2.0, at(5)), ("B", 3.0, at(9)), ("C", None, at(9))), batch(), batch(("B", 4.0, at(8)), ("A", None, at(7)), ("D", 6.0, None), ("D", 7.0, at(1)), ("E", 8.0, None))]))
    assert {t: p for t, _, p in sent.rows} == {"A": 2.0, "B": 3.0, "D": 7.0, "E": 8.0}

    rows = [(k, at(k), k % 7, "ab"[k // 2 % 2], float(k)) for k in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    os.makedirs(tmp_path / "one")
    base, was = f"file://{tmp_path}/base", spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a task per file
    try:
        markets._dealt(spark, str(tmp_path), base, lambda stream: L.push_prices(stream, str(tmp_path / "sent"), [str(tmp_path / "one")], f"{base}/log"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert all(len(list((tmp_path / "base/feed" / f"part={k}").glob("*.parquet"))) > 1 for k in range(2))
    for k, want in enumerate(({"a": 396.0, "b": 398.0}, {"a": 397.0, "b": 399.0})):
        assert {p["ticker"]: p["price"] for p in json.loads((tmp_path / "one" / f"{k}.json").read_text())["prices"]} == want
