"""The collapse by blocks against one loop over all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from posterboard.functions import fuzzy
from posterboard.functions.text import location_state, normalize_key, normalize_location
from posterboard.operators import alike, collapse
from posterboard.schemas import RECORD

D = dt.date
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def record(ordinal, **given):
    base = dict.fromkeys(NAMES) | {"ordinal": ordinal, "title": "Game night", "start_date": D(2026, 9, 5), "location": "Omak, WA", "source": "feeds", "source_url": f"http://x/{ordinal}", "confidence": 50, "warnings": [], "title_provisional": False, "manual_fields": []}
    return tuple((base | given)[c] for c in NAMES)


def one_loop(df):
    """Each row in order, against all that are kept so far."""
    keyed = df.select("*", normalize_key(F.col("title")).alias("key"), normalize_location(F.col("location")).alias("place"), location_state(F.col("location")).alias("state"))
    rows = [r.asDict() for r in keyed.collect()]
    rows.sort(key=lambda r: (-r["confidence"], -sum(bool(r[c]) for c in ("end_date", "tribe", "details", "flyer_url")), r["ordinal"]))
    kept, fate = [], {}

    def score(a, b):
        gap = None if a["start_date"] is None or b["start_date"] is None else abs((a["start_date"] - b["start_date"]).days)
        if a["flyer_phash"] and a["flyer_phash"] == b["flyer_phash"]:
            return 1.0 if gap is None or gap <= 7 else 0.0
        if (gap or 0) > 7 or (a["state"] and b["state"] and a["state"] != b["state"]):
            return 0.0
        near = None if gap is None else {0: 1.0, 1: 0.85, 2: 0.55, 3: 0.55}.get(gap, 0.25)
        p, t = fuzzy.name_likeness(a["place"], b["place"]), fuzzy.name_likeness(a["key"], b["key"])
        parts = [(x, w) for x, w in ((near, 0.45), (p, 0.30), (t, 0.25)) if x is not None]
        s = sum(x * w for x, w in parts) / sum(w for _, w in parts) if parts else 0.0
        return round(max(s, 0.92) if near and near >= 0.85 and p and p >= 0.85 else s, 3)

    for r in rows:
        best = max(kept, key=lambda k: score(r, k), default=None)
        if best is not None and score(r, best) >= 0.9:
            fate[r["ordinal"]] = best["ordinal"]
            for c in ("end_date", "location", "tribe", "details", "flyer_url", "raw_text"):
                if not best[c] and r[c]:
                    best[c] = r[c]
                    if c == "location":
                        best["place"], best["state"] = r["place"], r["state"]
            if len(r["title"] or "") > len(best["title"] or "") + 8:
                best["title"], best["key"] = r["title"], r["key"]
            if r["source"] and r["source"] not in best["source"]:
                best["source"] += f"+{r['source']}"
            if r["source_url"] and r["source_url"] != best["source_url"]:
                best["warnings"].append(f"also listed at {r['source_url']}")
            continue
        fate[r["ordinal"]] = None
        twin = next((k for k in kept if r["flyer_phash"] and k["flyer_phash"] == r["flyer_phash"]), None)
        if twin and twin["start_date"] != r["start_date"]:
            for one, other in ((r, twin), (twin, r)):
                one["warnings"].append(f"same flyer image as another event in this batch ({other['start_date']}) - check which date is right")
        kept.append(r)
    return fate, {k["ordinal"]: k for k in kept}


def batch(rng, n, days):
    titles = ["Game night", "Game nights", "Game night and feast of the valley", "Spring run", "Harvest fair", "Harvest fare of the old mill", None, "", "Run"]
    places = ["Omak, WA", "Omak, Washington", "Omack hall, WA", "Worley, ID", "Arlee, MT", "Old Mill", "Old Mill Road", "Mill Road", None, ""]
    out = []
    for i in range(n):
        day = None if rng.random() < 0.2 else D(2026, 9, 1) + dt.timedelta(days=rng.randrange(days))
        out.append(record(3 * i + 1, title=rng.choice(titles), start_date=day, location=rng.choice(places), confidence=rng.choice([40, 50, 60]), tribe=rng.choice([None, "River"]), source=rng.choice(["feeds", "reddit", "inbox"]),
                          flyer_phash=rng.choice([None] * 6 + ["", "aa", "bb"]), details=rng.choice([None, "", "x"])))
    return out


@pytest.mark.parametrize(("seed", "n", "days", "block"), [(1, 150, 12, 4096), (2, 150, 12, 20), (3, 120, 60, 7), (4, 120, 2, 15)])
def test_collapse_is_one_loop(spark, monkeypatch, seed, n, days, block):
    """Null and neighbouring dates, no titles or places, images; blocks of a few rows give what one block gives."""
    monkeypatch.setattr(collapse, "BLOCK_ROWS", block)
    df = spark.createDataFrame(batch(random.Random(seed), n, days), RECORD)
    fate, kept = one_loop(df)
    got = {r.ordinal: r for r in collapse.collapse(df).collect()}
    assert {o: r.merged_into for o, r in got.items()} == fate and 3 < len(kept) < n
    for o, k in kept.items():
        for c in ("title", "location", "tribe", "details", "source", "warnings", "confidence", "start_date", "flyer_phash"):
            assert (getattr(got[o], c) or None) == (k[c] or None), (o, c)


def test_a_chain_of_days_across_blocks(spark, monkeypatch):
    """An event on every day: each other day's is kept, however the chain is cut."""
    monkeypatch.setattr(collapse, "BLOCK_ROWS", 16)
    df = spark.createDataFrame([record(i, start_date=D(2026, 1, 1) + dt.timedelta(days=i)) for i in range(64)], RECORD)
    assert {r.ordinal: r.merged_into for r in collapse.collapse(df).collect()} == one_loop(df)[0]


def test_collapse_of_nothing(spark):
    assert collapse.collapse(spark.createDataFrame([], RECORD)).count() == 0


@pytest.mark.parametrize("least", [0.72, 0.85, 0.93])
def test_alike_pairs_lose_none(spark, least):
    rng = random.Random(int(100 * least))
    words = ["omak", "omack", "old", "mill", "road", "hall", "st", "community", "center", "centre", "of", "the", "river", "a", "b", "riverside", "x1"]
    keys = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(120)} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)})
    left, right = (spark.createDataFrame([(k,) for k in part], "key string") for part in (keys[::2], keys[1::2] + keys[:10]))
    got = {(r.a, r.b) for r in alike.alike_pairs(left, right, least).collect()}
    want = {(a, b) for a in keys[::2] for b in {*keys[1::2], *keys[:10]} if fuzzy.name_likeness(a, b) >= least}
    assert got == want and want


def test_keys_are_made_once_for_each_text(spark, monkeypatch):
    """Titles and places are many times their distinct texts, and their patterns are most of what a row costs before the run."""
    seen, decide = [], collapse.decide
    monkeypatch.setattr(collapse, "decide", lambda rows: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or decide(rows))
    rows = spark.createDataFrame([record(k, title=["Game night", "Open day", None][k % 3], location=[None, "Omak, WA"][k % 2]) for k in range(12)], RECORD)
    assert collapse.collapse(rows).count() == 12 and "Aggregate [title" in seen[0] and "Aggregate [location" in seen[0]
