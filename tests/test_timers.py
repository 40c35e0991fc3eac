"""Streams that forget by event time give what the batch forms give, across a restart."""

import datetime as dt
import random

import pytest

from posterboard.streaming import state, timers

START = dt.datetime(2026, 9, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    timers.use_timers(spark)
    yield spark
    spark.conf.set(name, before)


def through(spark, make, batches, kind, folder):
    """All rows that come out, each batch by a query of its own that goes on from the same checkpoint."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.json(f"{folder}/in/{i}")
        out = make(spark.readStream.schema(kind).json(f"{folder}/in/*"))
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(f"{folder}/out").collect()


def test_breaker_stream_is_the_batch_after_a_restart(rocks, tmp_path):
    rng = random.Random(5)
    kind = "host string, seq long, status int, retry_after double, at timestamp"
    rows = [(rng.choice(["a", "b", "c"]), i, rng.choice([429, 429, 200, None]), rng.choice([None, 1.0, 45.0, 900.0]), START + dt.timedelta(minutes=i)) for i in range(90)]
    got = through(rocks, timers.host_breaker_stream, [rows[:40], rows[40:70], [*rows[70:], (None, 900, 429, None, START), ("a", 901, 429, None, None)]], kind, str(tmp_path))
    want = state.host_breaker(rocks.createDataFrame(rows, kind)).collect()
    assert sorted((r.host, r.seq, r.delay_s, r.dropped) for r in got) == sorted((r.host, r.seq, r.delay_s, r.dropped) for r in want)
    assert any(r.dropped for r in got)


def test_breaker_forgets_a_silent_host(rocks, tmp_path):
    kind = "host string, seq long, status int, retry_after double, at timestamp"
    hit = lambda host, seq, hours: (host, seq, 429, None, START + dt.timedelta(hours=hours))
    batches = [[hit("a", i, 0) for i in range(3)], [hit("b", 3, 30)], [hit("b", 4, 31)], [hit("a", 5, 32)]]
    got = {r.seq: (r.delay_s, r.dropped) for r in through(rocks, timers.host_breaker_stream, batches, kind, str(tmp_path))}
    assert got[2] == (16.0, True) and got[5] == (4.0, False) and got[4] == (8.0, False)


def test_expiry_stream(rocks, tmp_path):
    kind = "key string, at timestamp"
    at = lambda key, hours: (key, START + dt.timedelta(hours=hours))
    batches = [[at("x", 0), at("y", 0), at("y", 1)], [at("x", 10), at(None, 3)], [at("z", 20), at("x", 9)], [at("z", 21)]]
    rows = through(rocks, lambda df: timers.expiry_stream(df, 12 * 3_600_000), batches, kind, str(tmp_path))
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    hours = [(r.key, (r.last_ms - base) // 3_600_000, r.expired) for r in rows]
    assert sorted(hours) == [("x", 0, False), ("x", 10, False), ("y", 1, False), ("y", 1, True), ("z", 20, False), ("z", 21, False)]
    cache = rocks.createDataFrame([("x", base + 10 * 3_600_000), ("y", base + 3_600_000), ("z", base + 21 * 3_600_000)], "key string, fetched_ms long")
    fresh = {r.key for r in state.fresh_cache(cache, base + 21 * 3_600_000).collect()}
    assert fresh == {k for k, _, gone in hours if not gone} - {k for k, _, gone in hours if gone}
