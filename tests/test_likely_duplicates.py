"""The check of a submission by windows of texts against a comparison of all rows."""

import datetime as dt
import random

import pytest

from posterboard.operators import listing



@pytest.mark.parametrize("seed", [1, 2])
def test_windows_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    words = ["Hall", "hall", "ONE", "a", "", "Größe", "ΣΣ", "100%", "_x_", "\\", "Customer 12", "Customer 123", "near\nby", "🙂🙂🙂🙂🙂"]
    text = lambda: rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 4)))])
    day = lambda: rng.choice([None, dt.date(2026, 9, 1), dt.date(2026, 9, 2)])
    # ids that stand in several rows, and none
    asked = [(rng.choice([None, *range(60)]), day(), text(), text()) for _ in range(80)]
    rows = [(rng.choice([None, *range(90)]), day(), text(), text()) for _ in range(120)]
    got = listing.likely_duplicates(spark.createDataFrame(asked, "sub_id int, start_date date, title string, location string"), spark.createDataFrame(rows, "id int, start_date date, title string, location string")).collect()
    key = lambda p: tuple((x is not None, x or 0) for x in p)
    want = {(s, i) for s, d, t, p in asked for i, e, u, q in rows if d is not None and d == e and any(a is not None and b is not None and b.lower() in a.lower() for a, b in ((u, t), (q, p)))}
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(want) > 100


def test_texts_of_a_day_are_looked_up(spark):
    """A day's distinct texts meet by a window, not all with all: of 4,000 that begin alike each meets a few."""
    df = spark.range(4000).selectExpr("date_add(date'2026-09-01', cast(id div 4000 as int)) AS start_date", "concat('customer ', 100000 + id) AS text")
    found = listing.containing(df.withColumnRenamed("text", "wanted"), df)
    assert found.count() == 4000
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
