"""Listing, linkage, memory, enrichment, sources, state: small tables with the awkward cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from posterboard.functions import fuzzy
from posterboard.operators import enrich, linkage, listing, memory, publish, reconcile
from posterboard.plans import run as plan
from posterboard.schemas import LEDGER, LISTING, MANIFEST, RECORD
from posterboard.sources import feeds, web
from posterboard.streaming import state

D = dt.date
STAMP = dt.datetime(2026, 8, 12)


def listings(spark, rows):
    full = [{c.split()[0]: None for c in LISTING.split(", ")} | r for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], LISTING)


def test_listing(spark):
    rows = listings(spark, [
        {"id": 1, "title": "A 50%_off", "start_date": D(2026, 8, 30), "end_date": D(2026, 9, 2), "location": "Omak"}, {"id": 2, "title": "B", "start_date": D(2026, 8, 12), "report_count": 3},
        {"id": 3, "title": "C", "start_date": D(2026, 9, 1), "end_date": D(2026, 8, 1)}, {"id": 4, "title": "D", "report_count": 2},
    ])
    assert {r.id for r in listing.visible(rows).collect()} == {1, 3, 4}
    assert {r.id for r in listing.past(rows, D(2026, 8, 12)).collect()} == {4}
    assert [(r.day, r.ids) for r in listing.calendar_days(rows, D(2026, 9, 5)).orderBy("day").collect()] == [(D(2026, 9, 1), [1]), (D(2026, 9, 2), [1])]
    assert {r.id for r in listing.search(rows, "0%_O").collect()} == {1} and listing.search(rows, " ").count() == 4
    asked = spark.createDataFrame([(9, D(2026, 8, 30), "%", "x"), (8, D(2026, 8, 30), "50%_off", "y")], "sub_id int, start_date date, title string, location string")
    assert {(r.sub_id, r.id) for r in listing.likely_duplicates(asked, rows).collect()} == {(9, 1), (8, 1)}
    assert {r.sub_id for r in listing.likely_duplicates(asked.withColumn("title", F.lit("5_%_off")), rows).collect()} == set()
    assert {r.sub_id for r in listing.likely_duplicates(asked.withColumn("title", F.lit("5_%_off")), rows, raw=True).collect()} == {8, 9}
    assert listing.form_errors(rows).where("id = 3").first().errors == ["location is missing", "ends before it starts"]
    assert listing.count_text(rows.where("id = 1"), "past").first().label == "1 past event"


def record(i, **kw):
    base = dict(title=f"Event {i}", start_date=D(2026, 9, 5), end_date=None, location="Nespelem, WA", tribe=None, details=None, flyer_url=None, source="webpages", source_url=f"http://x/{i}", source_posted_at=None,
                extraction="structured", confidence=50, warnings=[], flyer_phash=None, raw_text=None, first_seen=None, title_provisional=False, manual_fields=None, ordinal=i)
    return tuple((base | kw).values())


def brute_collapse(rows):
    """One loop over all rows, with a similarity written out anew."""
    from posterboard.functions.vocab import STATES

    def norm(s):
        import re

        s = re.sub("[^a-z0-9 ]+", " ", (s or "").lower().replace("&", " and "))
        return " ".join(s.split())

    def place(s):
        t = norm(s).split()
        if t and t[-1].upper() in STATES:
            t[-1] = STATES[t[-1].upper()].lower()
        return " ".join(t)

    def score(a, b):
        day = {0: 1.0, 1: .85, 2: .55, 3: .55}.get(abs((a["start_date"] - b["start_date"]).days), .25 if abs((a["start_date"] - b["start_date"]).days) <= 7 else 0.0)
        if day == 0 or place(a["location"]).split()[-1] != place(b["location"]).split()[-1]:
            return 0
        p, n = fuzzy.name_likeness(place(a["location"]), place(b["location"])), fuzzy.name_likeness(norm(a["title"]), norm(b["title"]))
        s = .45 * day + .3 * p + .25 * n
        return round(max(s, .92) if day >= .85 and p >= .85 else s, 3)

    names = [c.split()[0] for c in RECORD.split(", ")]
    rows = sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda r: (-r["confidence"], r["ordinal"]))
    kept, into = [], {}
    for r in rows:
        best = max(kept, key=lambda k: score(r, k), default=None)
        if best and score(r, best) >= .9:
            into[r["ordinal"]] = best["ordinal"]
            if len(r["title"]) > len(best["title"]) + 8:
                best["title"] = r["title"]
        else:
            kept.append(r)
            into[r["ordinal"]] = None
    return into


def test_collapse_is_the_global_loop(spark):
    rng = random.Random(5)
    rows = [record(i, title=rng.choice(["Game night", "Game night and feast of the valley", "Spring run", "Harvest fair"]), start_date=D(2026, 9, 1) + dt.timedelta(days=rng.randint(0, 25)),
                   location=rng.choice(["Omak, WA", "Omak, Washington", "Worley, ID", "Arlee, MT"]), confidence=rng.randint(1, 99)) for i in range(60)]
    df = spark.createDataFrame(rows, RECORD)
    got = {r.ordinal: r.merged_into for r in linkage.collapse(df).collect()}
    assert got == brute_collapse(rows)


def test_merge_and_image_twins(spark):
    rows = [
        record(1, title="Thin", confidence=90), record(2, title="A much fuller title here", tribe="Riverside", confidence=10, source="reddit"),
        record(3, title="Other", location="Arlee, MT", flyer_phash="ab" * 32, start_date=D(2026, 9, 5), confidence=5),
        record(4, title="Other", location="Arlee, MT", flyer_phash="ab" * 32, start_date=D(2027, 9, 5), confidence=4),
    ]
    out = {r.ordinal: r for r in linkage.collapse(spark.createDataFrame(rows, RECORD)).collect()}
    assert out[2].merged_into == 1 and out[1].title == "A much fuller title here" and out[1].tribe == "Riverside" and out[1].source == "webpages+reddit"
    assert out[1].warnings == ["also listed at http://x/2"] and out[4].merged_into is None
    kept = spark.createDataFrame(rows[2:], RECORD)
    assert {(r.ordinal, r.other_date) for r in linkage.image_twins(kept).collect()} == {(4, D(2026, 9, 5)), (3, D(2027, 9, 5))}


def test_best_match_is_brute_force(spark):
    """Null dates, places and titles on either side, and images up to a week apart and beyond."""
    rng = random.Random(1)
    day = lambda: None if rng.random() < 0.15 else D(2026, 9, 1) + dt.timedelta(days=rng.randint(0, 14))
    made = [(i, rng.choice([None, "", *[f"{a} {b}" for a in ("Quilt", "Quilting", "Spring", "Harbour") for b in ("night", "nights", "run", "supper", "x")]]), rng.choice([None, *[f"{a}, {b}" for a in ("Omak", "Omack hall", "Worley", "Elm Street") for b in ("WA", "ID", "Nowhere")]]), day(), rng.choice(["aa", "bb", *[None, ""] * 9])) for i in range(90)]
    kind = "id int, title string, location string, start_date date, flyer_phash string"
    l = spark.createDataFrame(made[:30], kind).withColumn("flagged", F.col("id") % 7 == 0)
    c = spark.createDataFrame(made[30:], kind).withColumn("fingerprint", F.col("id").cast("string"))
    every = c.select(F.struct(*c.columns).alias("l")).crossJoin(l.select(F.struct(*l.columns).alias("r"))).withColumn("s", fuzzy.similarity("l", "r"))
    order = F.struct("s", F.col("r.start_date"), -F.col("r.id"))
    best = {r.f: r for r in every.groupBy(F.col("l.fingerprint").alias("f")).agg(F.max("s").alias("s"), F.max_by("r.id", order).alias("id")).collect()}
    got = linkage.best_live_match(c, l).collect()
    assert len(got) == 60 and {r.verdict for r in got} == {"duplicate", "possible", "new"}
    for r in got:
        b = best[r.fingerprint]
        assert r.verdict == ("duplicate" if b.s >= 0.9 else "possible" if b.s >= 0.72 else "new"), (r, b)
        assert r.verdict == "new" or (abs(r.score - b.s) < 1e-9 and r.id == b.id)


def _best_by_all_pairs(c, l):
    every = c.select(F.struct(*c.columns).alias("l")).crossJoin(l.select(F.struct(*l.columns).alias("r"))).withColumn("s", fuzzy.similarity("l", "r"))
    order = F.struct("s", F.col("r.start_date"), -F.col("r.id"))
    return {r.f: r for r in every.groupBy(F.col("l.fingerprint").alias("f")).agg(F.max("s").alias("s"), F.max_by("r.id", order).alias("id")).collect()}


def test_best_match_on_a_hot_day(spark):
    """Most rows on one day and many of one image, in blocks of 16 profiles: the same as all pairs; nulls, repeats, clashing names and empty tables."""
    rng = random.Random(7)
    words = "quilt night harbour run supper spring fair omak garden river mill song dance".split()
    name = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice(["", "s", "x"])
    day = lambda: rng.choice([D(2026, 9, 1)] * 8 + [D(2026, 9, 2), D(2026, 9, 4), None])
    made = [(i, rng.choice([None, *[name(3)] * 8]), rng.choice([None, *[name(2) + rng.choice([", WA", ", ID", ""])] * 8]), day(), rng.choice(["aa", *[None] * 12])) for i in range(260)]
    kind = "id int, title string, location string, start_date date, flyer_phash string"
    l = spark.createDataFrame(made[:140] + [(900, *made[0][1:])], kind).withColumn("flagged", F.col("id") % 7 == 0)
    c = spark.createDataFrame(made[140:] + [(901, *made[3][1:]), (902, *made[3][1:]), (903, "zebra", "quay", D(2031, 1, 1), None)], kind).withColumn("fingerprint", F.col("id").cast("string")).withColumns({"cell": F.lit(1), "m": F.lit(2)})
    best = _best_by_all_pairs(c, l)
    for block in (16, 1024):
        got = linkage.best_live_match(c, l, block=block).collect()
        assert len(got) == 123 and {r.verdict for r in got} == {"duplicate", "possible", "new"}
        for r in got:
            b = best[r.fingerprint]
            assert (r.score, r.id) == ((b.s, b.id) if b.s >= 0.72 else (None, None)), (r, b)
    assert linkage.best_live_match(c.limit(0), l).count() == 0
    assert {r.verdict for r in linkage.best_live_match(c, l.limit(0)).collect()} == {"new"}


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab c", k=rng.randint(0, 9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        assert fuzzy.edit_distance(a, b) == row[-1]


def test_merged_into_is_whole(spark):
    """Ordinals beyond 2 ** 53 come out whole; a run of neighbouring days without states is gone through."""
    big = 104916390988172875
    rows = [record(big + 2 * i, title="Game night", location="Old Mill", start_date=D(2026, 6, 1) + dt.timedelta(days=i // 2), confidence=90 - i % 2) for i in range(120)]
    out = linkage.collapse(spark.createDataFrame(rows, RECORD)).collect()
    ordinals = {r.ordinal for r in out}
    assert len(ordinals) == 120 and ordinals >= {r.merged_into for r in out if r.merged_into is not None} and any(r.merged_into for r in out)


def test_no_product_in_match_plans(spark):
    rows = spark.createDataFrame([(*record(1), "f", 1, False)], f"{RECORD}, fingerprint string, id int, flagged boolean")
    plan_text = linkage.best_live_match(rows, rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan_text and "BroadcastNestedLoopJoin" not in plan_text


def test_memory(spark):
    ledger = spark.createDataFrame([("f1", "T", D(2026, 9, 1), "2026-09-01|omak", "f" * 64, "s", None, "queued", STAMP, STAMP), ("f2", "U", D(2020, 1, 1), "|x", None, "s", None, "queued", STAMP, STAMP)], LEDGER)
    rows = spark.createDataFrame([("f1", "m1", None, D(2026, 9, 1), []), ("n1", "2026-09-01|omak", None, D(2026, 9, 1), []), ("n2", "|x", "f" * 63 + "e", D(2026, 9, 1), []), ("n3", "m", "f" * 63 + "e", D(2026, 10, 1), []), ("n4", "m", "0" * 64, None, [])],
                                 "fingerprint string, match_key string, flyer_phash string, start_date date, warnings array<string>")
    assert {r.fingerprint for r in memory.unseen(rows, ledger).collect()} == {"n1", "n2", "n3", "n4"}
    assert {r.fingerprint for r in memory.unseen_key(rows, ledger).collect()} == {"f1", "n2", "n3", "n4"}
    assert {r.fingerprint: r.image_verdict for r in memory.judge_image_twins(rows, ledger).collect()} == {"f1": "none", "n1": "none", "n2": "drop", "n3": "warn", "n4": "none"}
    assert memory.prune(ledger, D(2026, 8, 12)).count() == 1 and memory.forget(ledger, rows.select("fingerprint")).count() == 1
    new = spark.createDataFrame([("f1", "", None, "", None, "", "u", "already-on-site"), ("f3", "W", None, "k", None, "s", None, "queued")], "fingerprint string, title string, start_date date, match_key string, phash string, source string, source_url string, outcome string")
    later = dt.datetime(2026, 9, 9)
    got = {r.fingerprint: r for r in memory.record(ledger, new, later).collect()}
    assert got["f1"].title == "T" and got["f1"].outcome == "already-on-site" and got["f1"].first_seen == STAMP and got["f1"].last_seen == later and got["f1"].source_url == "u"
    assert got["f2"].last_seen == STAMP and got["f3"].first_seen == later


def test_near_hash_is_brute_force(spark):
    rng = random.Random(2)
    base = rng.getrandbits(256)
    hashes = [(i, f"{base ^ sum(1 << b for b in rng.sample(range(256), rng.randint(0, 16))):064x}") for i in range(40)]
    df = spark.createDataFrame(hashes, "a int, h string")
    got = {(r.a, r.b): r.bits for r in memory.near_hash_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", "h").collect()}
    want = {(i, j): bin(int(x, 16) ^ int(y, 16)).count("1") for i, x in hashes for j, y in hashes if bin(int(x, 16) ^ int(y, 16)).count("1") <= 12}
    assert got == want


def test_reader_precedence(spark):
    reader = "struct<title:string,start_date:string,end_date:string,location:string,tribe:string,details:string,is_topic:boolean,year_printed:boolean>"
    good = ("New title", "2026-09-09", "soon", "Omak, WA", "Spokane", "x", True, False)
    cases = [record(1), record(2, source="calendars"), record(3, manual_fields=["title", "start_date"]), record(4)]
    df = spark.createDataFrame([(*c, good if c[-1] != 4 else (*good[:6], False, None)) for c in cases], f"{RECORD}, reader {reader}")
    out = {r.ordinal: r for r in enrich.fill_from_reader(df).collect()}
    assert out[1].title == "New title" and out[1].start_date == D(2026, 9, 9) and out[1].end_date is None and len(out[1].warnings) == 2 and out[1].extraction == "llm"
    assert out[2].title == "Event 2" and out[2].tribe == "Spokane" and out[3].title == "Event 3" and out[3].start_date == D(2026, 9, 5) and out[3].location == "Omak, WA"
    assert out[4].title == "Event 4" and len(out[4].warnings) == 1


def test_feeds_and_pages(spark):
    wp = '{"events":[{"title":"Chess &#038; Feast","description":"<p>fun</p>","start_date":"2026-09-18 10:00:00","image":{"url":"http://i/a.jpg"},"venue":{"venue":"Hall","city":"","state":"WA"}},{"title":"Bingo"}]}'
    ics = "BEGIN:VEVENT\r\nSUMMARY:Speed game \r\n tournament\\, big\r\nDTSTART;VALUE=DATE:20261212\r\nDTEND:20261214\r\nDTSTART:20200101\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Bingo\r\nEND:VEVENT"
    bodies = lambda b: spark.createDataFrame([("http://s", b, "Site, WA", None, None), ("http://t", "junk", None, None, None)], "url string, body string, site_location string, site_tribe string, hint string")
    (a,) = feeds.from_event_json(bodies(wp)).collect()
    assert (a.title, a.start_date, a.location, a.flyer_url) == ("Chess & Feast", D(2026, 9, 18), "Hall, WA", "http://i/a.jpg")
    (b,) = feeds.from_ics(bodies(ics)).collect()
    assert (b.title, b.start_date, b.end_date, b.location) == ("Speed game tournament, big", D(2026, 12, 12), D(2026, 12, 14), "Site, WA")
    post = '{"data":{"children":[{"data":{"id":"x","title":"Chess Sept 5, 2026 in Omak, WA","selftext":"","permalink":"/r","preview":{"images":[{"source":{"url":"http://p/a?b&amp;c"}}]}}},{"data":{"id":"y","title":"hello"}}]}}'
    (p,) = feeds.from_posts(bodies(post), D(2026, 8, 12)).collect()
    assert (p.start_date, p.location, p.flyer_url) == (D(2026, 9, 5), "Omak, Washington", "http://p/a?b&c")
    html = ('<html><nav>Chess menu</nav><script type="application/ld+json">{"@graph":[{"@type":["Event"],"name":"Chess","startDate":"2026-10-10T10:00","location":{"name":"Hall","address":{"addressLocality":"Omak","addressRegion":"WA"}},"image":["http://i/x.png"]}]}</script>'
            '<script type="application/ld+json">{bad</script><article class="event"><h2>Speed game at the hall</h2><p>May 22-25, 2027 Omak, WA</p><img src="/f/flyer.jpg" width="300" height="400"><img src="/logo.png"><a href="/e/1">more</a></article><article><p>nothing here at all, really</p></article></html>')
    pages = spark.createDataFrame([(1, "http://s/list", html, None, None, None), (2, "http://s/x", None, None, None, None)], "page_id int, url string, html string, site_location string, site_tribe string, hint string")
    (j,) = web.from_jsonld(pages).collect()
    assert (j.start_date, j.location, j.flyer_url) == (D(2026, 10, 10), "Hall, Omak, WA", "http://i/x.png")
    (h,) = web.from_html(pages, D(2026, 8, 12)).collect()
    assert (h.title, h.start_date, h.end_date, h.flyer_url, h.source_url, h.location) == ("Speed game at the hall", D(2027, 5, 22), D(2027, 5, 25), "http://s/f/flyer.jpg", "http://s/e/1", "Omak, Washington")


def test_rate_limit(spark):
    rng = random.Random(4)
    rows = [(c, rng.randint(0, 20_000_000), i) for i, c in enumerate(rng.choices("ab", k=120))]
    got = {r.seq: r.accepted for r in state.rate_limited(spark.createDataFrame(rows, "client string, ms long, seq long")).collect()}
    for c in "ab":
        taken = []
        for _, t, i in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2])):
            ok = sum(t - x < 3_600_000 for x in taken) < 3
            taken += [t] * ok
            assert got[i] == ok


def test_rate_limit_stream(spark, tmp_path):
    kind = "client string, ms long, seq long"
    rows = spark.createDataFrame([("a", 1000 * i, i) for i in range(5)], kind)
    rows.write.json(str(tmp_path / "in"))
    q = state.rate_limited_stream(spark.readStream.schema(kind).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r.seq, r.accepted) for r in spark.table("limited").collect()) == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_inventory(spark):
    t = dt.datetime(2026, 1, 1)
    manifest = spark.createDataFrame([("a", 1, True, t, t, None), ("b", 2, True, t, t, None), ("c", 3, False, t, t, t), ("d", 4, False, t, t, t)], MANIFEST)
    bucket = spark.createDataFrame([("a", 1), ("d", 4), ("e", 5)], "name string, size long")
    out = {r.name: r for r in reconcile.reconcile(manifest, bucket, STAMP).collect()}
    assert {k: v.action for k, v in out.items()} == {"a": "skipped", "b": "vanished", "c": "gone", "d": "skipped", "e": "added"}
    assert out["b"].gone_since == STAMP and out["c"].gone_since == t and out["d"].gone_since == t and out["d"].in_bucket


def test_publish_isolates_failures(spark):
    rows = spark.createDataFrame([("k1", *record(1)), ("k2", *record(2, title="bad")), ("k3", *record(3, title=None))], f"fingerprint string, {RECORD}")

    def send(row, approved):
        if row["title"] == "bad" or approved:
            raise ValueError("refused")

    assert {r.fingerprint: r.status for r in publish.publish(rows, send).collect()} == {"k1": "added", "k2": "failed"}


def test_whole_run(spark):
    pages = spark.createDataFrame([("CHESS TOURNAMENT\nSept 4-6, 2026 Nespelem, WA\ncall 509-555-0100", "http://a"), ("Chess July 1, 2020 Omak, WA", "http://b"), ("Bingo Sept 4, 2026", "http://c")], "raw_text string, source_url string")
    live = listings(spark, [])
    empty = spark.createDataFrame([], LEDGER)
    first = plan.run({"webpages": pages}, empty, live, D(2026, 8, 12), STAMP)
    s = first.statistics.first()
    assert (s.collected, s.queued, s.off_topic) == (0, 0, 0)  # records with neither title nor image aren't collected
    pages = pages.withColumn("title", F.lit("")).withColumn("flyer_url", F.lit("http://i/a.jpg"))
    first = plan.run({"webpages": pages}, empty, live, D(2026, 8, 12), STAMP)
    s = first.statistics.first()
    assert (s.collected, s.queued, s.off_topic, s.past) == (3, 1, 1, 1)
    assert s.collected == s.off_topic + s.incomplete + s.past + s.merged + s.seen + s.live + s.flagged + s.queued
    again = plan.run({"webpages": pages}, first.ledger, live, D(2026, 8, 12), STAMP).statistics.first()
    assert (again.queued, again.seen) == (0, 1)
    site = listings(spark, [{"id": 1, "title": "Chess tournament", "start_date": D(2026, 9, 4), "location": "Nespelem, Washington"}])
    assert plan.run({"webpages": pages}, empty, site, D(2026, 8, 12), STAMP).statistics.first().live == 1


def test_near_hashes_of_16_digits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(4)]
    hashes = [(i, f"{rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 14))):016x}") for i in range(80)] + [(90, "0" * 16), (91, "0" * 16), (92, None), (93, ""), (94, "xyz"), (95, "F" * 16), (96, "f" * 16)]
    df = spark.createDataFrame(hashes, "a int, h string")
    got = {(r.a, r.b): r.bits for r in memory.near_hash_short(df, df.withColumnRenamed("a", "b"), "a", "b", "h").collect()}
    good = [(i, int(x, 16)) for i, x in hashes if x and len(x) == 16]
    want = {(i, j): (x ^ y).bit_count() for i, x in good for j, y in good if (x ^ y).bit_count() <= 12}
    assert got == want and len(want) > 200
    for bits in (0, 2, 5, 13):
        got = {(r.a, r.b) for r in memory.near_hash_short(df, df.withColumnRenamed("a", "b"), "a", "b", "h", bits).collect()}
        assert got == {(i, j) for i, x in good for j, y in good if (x ^ y).bit_count() <= bits}


def test_phone_numbers_keep_their_digits(spark):
    from posterboard.functions.text import find_contact

    numbers = ["206-555-1220", "206-555-1221", "206-555-1222", "206-555-1223"]
    text = "call " + " or ".join(numbers)
    assert spark.range(1).select(find_contact(F.lit(text))).first()[0] == ", ".join(numbers)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    kind = "fingerprint string, title string, start_date date, match_key string, phash string, source string, source_url string, outcome string"
    row = lambda f, title: (f, title, D(2026, 9, 1), "k", None, "s", None, "queued")
    folder, day = f"file://{tmp_path}/ledger", lambda n: STAMP + dt.timedelta(days=n)
    write = memory.recorder(folder, day)
    first, second = spark.createDataFrame([row("a", "one"), row("b", "two")], kind), spark.createDataFrame([row("a", "one more"), row("c", "three")], kind)
    write(first, 0)
    write(second, 1)
    said = sorted(map(tuple, memory.load(spark, folder).collect()))
    for batch, number in ((first, 0), (second, 1)):  # as after a restart
        memory.recorder(folder, day)(batch, number)
    assert sorted(map(tuple, memory.load(spark, folder).collect())) == said
    got = {r.fingerprint: r for r in memory.load(spark, folder).collect()}
    assert got["a"].title == "one more" and got["a"].first_seen == day(0) and got["a"].last_seen == day(1) and set(got) == {"a", "b", "c"}
    source = spark.createDataFrame([row("d", "four")], kind)
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in").writeStream.foreachBatch(memory.recorder(folder, day, "other")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert stream.awaitTermination(60) and {r.fingerprint for r in memory.load(spark, folder).collect()} == {"a", "b", "c", "d"}


def test_image_verdicts_beside_hashes_that_are_near_by_chance(spark, tmp_path):
    """The first 16 digits of 9082 and 64280 are 12 bits apart, and they are of no three."""
    import duckdb

    from posterboard.plans.queries import QUERIES, SQL

    spark.createDataFrame([(k,) for k in (9081, 9082, 9083, 64280, 5, 4, 3)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    want = duckdb.connect().execute(SQL["image_verdicts"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in QUERIES["image_verdicts"](spark, str(tmp_path)).collect()) == sorted(want)


def test_bands_are_never_broadcast(spark, tmp_path):
    """A table small enough to be sent to all tasks isn't, once each row is 13; a pair that shares several bands comes once."""
    rng = random.Random(6)
    base = rng.getrandbits(256)
    at = [i * 20 for i in range(13)]
    hashes = [(0, f"{base:064x}"), (1, f"{base ^ sum(1 << 255 - b for b in at[:12]):064X}"), (2, f"{base ^ sum(1 << 255 - b for b in at):064x}"), (3, f"{base ^ 1:064x}"), (4, f"{base:063x}"[:63]), (5, None), (6, "g" * 64)]
    spark.createDataFrame(hashes, "a int, h string").write.parquet(f"{tmp_path}/h")
    df = spark.read.parquet(f"{tmp_path}/h")
    pairs = memory.near_hash_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", "h")
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    good = [(i, int(h, 16)) for i, h in hashes[:4]]
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j, (x ^ y).bit_count()) for i, x in good for j, y in good if (x ^ y).bit_count() <= 12)
