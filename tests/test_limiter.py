"""The limiter by spans against one loop over a client's attempts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posterboard.streaming import limiter
from posterboard.streaming.state import accept


def loop(times, most, window):
    return accept(times, [], most, window)[0]


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_functions_of_spans(most):
    """Any span's table, looked up with any times of before, ends as the loop does."""
    rng = random.Random(most)
    for _ in range(120):
        window = rng.choice([1, 3, 10, 40])
        length = window * rng.choice([1, 2, 5])
        density = rng.choice([0.05, 0.5, 1, 4])
        times = sorted(rng.randrange(0, 6 * length) for _ in range(max(1, int(6 * length * density))))
        want, left, got, before = loop(times, most, window), [], [], None
        for span in sorted({t // length for t in times}):
            mine = np.array([t for t in times if t // length == span])
            recent = left if before == span - 1 else []
            ok = np.zeros(len(mine), bool)
            ok[limiter._accepted(limiter._after(mine, window), limiter._firsts(mine, recent, most, window))] = True
            got += ok.tolist()
            heads = mine[mine < span * length + window]
            table, firsts = limiter._function(mine, len(heads), most, window), limiter._firsts(heads, recent, most, window)
            ends = np.max([table[:, j, p] for j, p in enumerate(firsts)], axis=0) if len(table) else []
            left, before = [int(t) for t in ends if t < limiter.NEVER][-most:], span
        assert got == want


@pytest.mark.parametrize("windows", [1, 2, 16])
def test_rate_limited_in_spans(spark, windows):
    rng = random.Random(windows)
    rows = [(c, rng.randint(-3000, 12_000), i) for i, c in enumerate(rng.choices(["busy", "b", None], weights=[20, 1, 1], k=4000))]
    rows += [("every", t, 10_000 + t) for t in range(0, 2500)] + [("rare", 977 * t, 20_000 + t) for t in range(60)] + [("once", 5, 30_000)]
    df = spark.createDataFrame(rows + [("busy", None, -1), (None, None, -2)], "client string, ms long, seq long").withColumn("span", F.lit("clash"))
    got = {r.seq: r.accepted for r in limiter.rate_limited(df, 3, 100, windows).collect()}
    want = {-1: False, -2: False}
    for c in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == c)
        want |= dict(zip([i for _, i in mine], loop([t for t, _ in mine], 3, 100)))
    assert got == want


def test_rate_limited_edges(spark):
    kind = "client string, ms long, seq long"
    assert limiter.rate_limited(spark.createDataFrame([], kind)).count() == 0
    same = spark.createDataFrame([("a", 7, 1)] * 5, kind)
    assert sorted(r.accepted for r in limiter.rate_limited(same).collect()) == [False, False, True, True, True]
    with pytest.raises(ValueError):
        limiter.rate_limited(same, most=0)


def test_many_clients_of_few_attempts(spark):
    """Spans go through tasks many at a time, not one by one; ids past the doubles and a null stay as they are."""
    rng = random.Random(9)
    rows = [(2**60 + c if c else None, rng.randint(0, 2000), 10 * c + i) for c in range(3000) for i in range(rng.choice([1, 2, 6]))]
    df = limiter.rate_limited(spark.createDataFrame(rows, "client long, ms long, seq long"), 3, 100, 2)
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == c)
        want |= {(c, i): ok for (_, i), ok in zip(mine, loop([t for t, _ in mine], 3, 100))}
    assert {(r.client, r.seq): r.accepted for r in df.collect()} == want and not all(want.values())


def test_spans_that_batches_cut(spark):
    """A span's rows come in several Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(3)
        rows = [("a", rng.randint(0, 900), i) for i in range(200)] + [("b", rng.randint(0, 900), 1000 + i) for i in range(5)]
        got = {r.seq: r.accepted for r in limiter.rate_limited(spark.createDataFrame(rows, "client string, ms long, seq long"), 3, 100, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in "ab":
        mine = sorted((r[1], r[2]) for r in rows if r[0] == c)
        assert [got[i] for _, i in mine] == loop([t for t, _ in mine], 3, 100)
