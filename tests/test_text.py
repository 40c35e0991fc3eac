"""Vectors for the text, date and likeness functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from posterboard.functions import fuzzy, hashing
from posterboard.functions import text as T
from posterboard.functions.dates import PAST, find_dates, scan

TODAY = dt.date(2026, 8, 12)


@pytest.mark.parametrize(("text", "start", "end"), [
    ("SEPTEMBER 12-14, 2026", "2026-09-12", "2026-09-14"), ("Sept 12th - 14th, 2026", "2026-09-12", "2026-09-14"), ("September 12, 2026", "2026-09-12", None),
    ("AUGUST 29 - SEPTEMBER 1, 2026", "2026-08-29", "2026-09-01"), ("12 September 2026", "2026-09-12", None), ("9/12/2026", "2026-09-12", None), ("2026-09-12", "2026-09-12", None),
    ("LABOR DAY WEEKEND - SEPT 5 & 6", "2026-09-05", "2026-09-06"), ("December 5, 2026", "2026-12-05", None), ("March 14", "2027-03-14", None),
    ("Doors 5:00 PM · Games start 7:00 PM · October 3, 2026", "2026-10-03", None), ("come on down, prizes for all", None, None),
    ("AUGUST 29, 30, 31", "2026-08-29", "2026-08-31"), ("SEPT 12, 13 & 14", "2026-09-12", "2026-09-14"), ("Sept 12 '26", "2026-09-12", None),
])
def test_dates(text, start, end):
    a, b, _ = scan(text, TODAY)
    assert (a and a.isoformat(), b and b.isoformat()) == (start, end)


def test_date_warnings():
    assert scan("July 4, 2019", TODAY)[2] == [PAST]
    for text, warns in (("Thursday, July 7, 2026", True), ("Thursday, July 9, 2026", False), ("Monday 27 June 2026", True), ("Sat, Jun 27 2026", False), ("Thursday we meet, then July 7, 2026", False)):
        assert any("the text says" in n for n in scan(text, TODAY)[2]) == warns, text
    note = scan("FRIDAY | MAY 22", TODAY)[2]
    assert any("2026" in n and "old listing" in n for n in note)


def test_dates_on_columns(spark):
    rows = spark.createDataFrame([(1, "Sept 12-14, 2026"), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", find_dates(F.col("t"), TODAY).alias("d")).collect()}
    assert got[1].start == dt.date(2026, 9, 12) and got[1].end == dt.date(2026, 9, 14) and got[2].start is None and got[3].warnings == []


def column(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_places(spark):
    assert column(spark, T.find_location, [
        "Held at Nespelem, WA on the powwow grounds", "WELLPINIT, WASHINGTON", "at the Spokane Tribal Gym", "Kamloops, BC", "Game at Ft Duchesne", "Sparks fly at the annual tournament",
        "Swinomish Casino & Lodge, La Conner, WA", None,
    ]) == ["Nespelem, Washington", "Wellpinit, Washington", "the Spokane Tribal Gym", "Kamloops, British Columbia", "Fort Duchesne, Utah", None, "La Conner, Washington", None]
    assert column(spark, T.location_state, ["Community Center in Omak, WA", "Santa Fe, New Mexico", "Charleston, West Virginia", "nowhere", None]) == ["Washington", "New Mexico", "West Virginia", None, None]
    assert column(spark, T.normalize_location, ["Nespelem, WA", "the grounds at Nespelem, Washington"]) == ["nespelem washington"] * 2


def test_places_of_one_length(spark):
    """Of towns of one length the first in the vocabulary wins."""
    assert column(spark, T.find_location, ["arlee or lummi", "polson and schurz", "meet at the Old Mill Park", "Omak, Washington, then St. Mary's, MT and more"]) == ["Lummi, Washington", "Polson, Montana", "the Old Mill Park", "St. Mary's, Montana"]


def test_entities(spark):
    assert column(spark, T.strip_html, ["caf&eacute; &copy; &#233; &#x41; &lt;b&gt;", "no entity", "R&D", None]) == ["café © é A <b>", "no entity", "R&D", None]


def test_entities_that_were_cut_through(spark, tmp_path):
    """A tag that stands inside an entity leaves a part of it; the standard's reading of that part is not the query's."""
    import duckdb

    from posterboard.plans.queries import QUERIES, SQL

    texts = ["a &quo<b>t; b", "a &quot<i> p{margin:0}; b", "&copy<i> &lt <b>&#39<i>; &amp<b>; &am<i>p; &ampquot; &amp;lt; &notit; &eacute", "x &middot; y &#039;&#8211;&apos;", "&", "", None]
    assert column(spark, T.strip_html, texts)[1:2] == ['a " p{margin:0}; b']
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.connect().execute(SQL["html_strip"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in QUERIES["html_strip"](spark, str(tmp_path)).collect()) == sorted(want)


def test_more_dates():
    d = lambda *x: dt.date(*x)
    for text, want in {
        "Febuary 14, 2027": (d(2027, 2, 14), None), "May 30 - June 2": (d(2027, 5, 30), d(2027, 6, 2)), "Dec. 30 to Jan 2, 2027": (d(2027, 12, 30), d(2028, 1, 2)),
        "10am-5pm Sat 3 Oct. 2026": (d(2026, 10, 3), None), "Oct 3 2026, Oct 5 2026": (d(2026, 10, 3), d(2026, 10, 5)), "3/4": (d(2027, 3, 4), None), "25/12/2026": (None, None), "9-12-26": (d(2026, 9, 12), None),
        "Feb 30, 2027": (None, None), "in May we said 2026": (None, None),
    }.items():
        assert scan(text, TODAY)[:2] == want, text
    assert any("ambiguous" in n for n in scan("3/4", TODAY)[2])


def test_vocabulary_from_a_table(spark):
    from posterboard.functions import vocab

    rows = spark.createDataFrame([("strong", "quilting", None, 2), ("strong", "knitting", None, 1), ("towns", "ely", "Ely, Nevada", 1)], "kind string, term string, value string, place int")
    with vocab.using(vocab.Vocabulary.of_table(rows)) as v:
        assert v.strong == ["knitting", "quilting"] and v.support
        assert column(spark, T.topic_tenths, ["a quilting day", "chess"]) == [7, 0] and column(spark, T.find_location, ["in Ely"]) == ["Ely, Nevada"]


def test_groups_topics_titles(spark):
    assert column(spark, T.find_tribe, ["Hosted by the Riverside Garden Club", "Hosted by the neighbourhood association", "Garden Club"]) == ["Riverside", None, "Garden Club"]
    assert column(spark, T.topic_tenths, ["Annual Chess Tournament", "Fortnite video game tournament, $500 payout", "", None, "chess, not fortnite"]) == [8, 0, 0, 0, 7]
    assert column(spark, lambda c: T.topic_tenths(c, F.lit("speed game chess tournament")), ["Bingo night"]) == [1]
    flyer = "COME ON DOWN\nLABOR DAY CHESS TOURNAMENT\nSept 5\ncall 509-555-0142 or a@b.org\n509-555-0142"
    assert column(spark, T.guess_title, [flyer, "", None, "x\nplain line"]) == ["LABOR DAY CHESS TOURNAMENT", None, None, "plain line"]
    assert column(spark, T.find_contact, [flyer, "none"]) == ["509-555-0142, a@b.org", None]
    assert len(set(column(spark, T.normalize_key, ["Speed Game Tourney", "Chess Tournament", "the annual chess  competition!"])[:2])) == 1
    assert column(spark, T.soften_shouting, ["TEST EVENT NAME HERE", "Mixed Case", "THE BIG WA GAME"]) == ["Test Event Name Here", "Mixed Case", "THE BIG WA Game"]
    assert column(spark, lambda c: T.clean(c, 5), [" - a   b • ", "  ", None, "abcdefgh"]) == ["a b", None, None, "abcde"]
    assert column(spark, T.strip_html, ["<p>a&nbsp;<b>b</b> &#038; c</p>"]) == ["a b & c"]


def test_keys_and_hashes(spark):
    a, b = "f" * 64, "f" * 60 + "0007"
    rows = spark.createDataFrame([(a, b), (a, a), (a, "zz"), (None, a)], "a string, b string").select(hashing.hamming(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in rows.collect()] == [13, 0, None, None]
    keys = spark.createDataFrame([("u", "Title", dt.date(2026, 1, 2), "Omak, WA"), (None, None, None, None)], "u string, t string, s date, l string")
    got = keys.select(hashing.fingerprint(*map(F.col, "utsl")).alias("f"), hashing.match_key(F.col("s"), F.col("l")).alias("m")).collect()
    import hashlib

    assert got[0].f == hashlib.sha1(b"u|title|2026-01-02|omak washington").hexdigest()[:16] and got[0].m == "2026-01-02|omak washington"
    assert got[1].f == hashlib.sha1(b"|||").hexdigest()[:16] and got[1].m == "|"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_likeness():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert fuzzy.common_subsequence(a, b) == slow_lcs(a, b)
    assert fuzzy.token_set_ratio("labor day chess tournament", "chess tournament") == 100
    assert fuzzy.name_likeness("", "x") is None and fuzzy.ratio("abc", "abc") == 100


def test_partial_ratio_is_every_window():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))) for _ in "ab")
        short, long = sorted((a, b), key=len)
        n = len(short)
        want = max(fuzzy.ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(want), (a, b)


def test_ten_thousand_names(spark):
    """The longest of many names in one pass: as a search for each of them, longest first."""
    import random
    import re
    import time

    from posterboard.functions import vocab

    rng = random.Random(8)
    syllables = ["ka", "lo", "mi", "ra", "tu", "ne", "so", "wi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))).title()
    names = list(dict.fromkeys([" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(10_000)] + ["St. Ka", "Lo-Mi"]))
    texts = [" ".join(rng.choice([word(), rng.choice(names), "and", "the"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", None, "near ST. KA now", "lo-mi"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(1)
    with vocab.using(vocab.Vocabulary(groups=names, generic_groups=[])):
        few = df.select("i", T.find_tribe(F.col("text")).alias("name"))
        got = {r.i: r.name for r in few.collect()}
    order = sorted(names, key=len, reverse=True)
    for i, t in enumerate(texts):
        low = (t or "").lower()
        want = next((n for n in order if n.lower() in low and re.search(rf"\b{re.escape(n.lower())}\b", low)), None)
        assert got[i] == want, (t, got[i], want)
    many = df.crossJoin(spark.range(50)).select(F.concat_ws(" ", "text", F.col("id").cast("string")).alias("text"))
    with vocab.using(vocab.Vocabulary(groups=names, generic_groups=[])):
        plan = many.select(T.find_tribe(F.col("text")).alias("name"))
        start = time.perf_counter()
        assert plan.where("name IS NOT NULL").count() > 1000
        assert time.perf_counter() - start < 60
