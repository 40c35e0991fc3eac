"""Inbox, source contract, site and search scans, and the files of a run."""

import datetime as dt
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from posterboard.operators import listing, memory, publish, reconcile
from posterboard.schemas import LEDGER
from posterboard.sources import base, feeds, inbox, web

AS_OF = dt.date(2026, 6, 1)


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_inbox(spark, folder):
    for name in ("spring_chess-open.JPG", "b.png", ".hidden.png", "other.pdf", "c.webp"):
        (folder / name).write_bytes(b"x")
    (folder / "b.txt").write_text("Title: First\nTITLE: River: Open\ndate: July 9-12, 2026\nempty:\nlocation: Arlee, MT\nno field\n")
    (folder / "c.txt").write_text("date: whenever\nend: 2026-08-02\nflyer_url: https://x.org/c.webp\nurl: https://x.org/c")
    (folder / "links.txt").write_text("# a comment\n\nhttps://x.org/a.png?s=1 Open night\nhttps://x.org/b.PNG\nhttps://x.org/page\nhttps://x.org/gone my note\n")
    (folder / "more").mkdir()
    pages = spark.createDataFrame([("https://x.org/page", "<h1>Spring chess tournament</h1><p>May 3, 2027 at Polson</p>"), ("https://x.org/gone", "")], "url string, html string")
    got = {r.source_url.rsplit("/", 1)[-1]: r for r in inbox.scan(spark, str(folder), pages, AS_OF).collect()}
    assert sorted(got) == ["a.png?s=1", "b.PNG", "b.png", "c", "gone", "page", "spring_chess-open.JPG"]
    named, noted, ranged = got["spring_chess-open.JPG"], got["b.png"], got["c"]
    assert (named.title, named.title_provisional, named.manual_fields, named.start_date) == ("spring chess open", True, [], None)
    assert named.flyer_url == f"local://{folder}/spring_chess-open.JPG" and named.confidence == 40
    assert (noted.title, noted.title_provisional, noted.start_date, noted.end_date) == ("River: Open", False, dt.date(2026, 7, 9), dt.date(2026, 7, 12))
    assert noted.manual_fields == ["title", "start_date", "end_date", "location"]
    assert (ranged.start_date, ranged.end_date, ranged.flyer_url, ranged.manual_fields) == (None, dt.date(2026, 8, 2), "https://x.org/c.webp", ["end_date"])
    assert (got["a.png?s=1"].title, got["a.png?s=1"].details, got["a.png?s=1"].manual_fields) == ("Open night", "Open night", ["title", "details"])
    assert (got["b.PNG"].title, got["b.PNG"].details) == ("Flyer from pasted link", None)
    assert (got["page"].title, got["page"].start_date, got["page"].location, got["page"].confidence) == ("Spring chess tournament", dt.date(2027, 5, 3), "Polson, Montana", 35)
    assert (got["gone"].title, got["gone"].confidence, got["gone"].warnings) == ("my note", 15, ["page could not be fetched - fill in by hand"])


def test_sources_fail_alone(spark):
    good = lambda s: s.createDataFrame([("a",)], "title string")
    late = lambda s: s.range(3).select(F.raise_error(F.lit("no luck")).cast("string").alias("title"))
    made = [base.Source("good", good), base.Source("late", late), base.Source("off", good, enabled=False), base.Source("keyless", good, obstacle=lambda: "no key"), base.Source("absent", lambda s: s.read.parquet("/tmp/none-at-all"))]
    rows, outcomes = base.read_all(spark, made)
    assert [(o.name, o.state) for o in outcomes] == [("good", "read"), ("late", "failed"), ("off", "disabled"), ("keyless", "unavailable"), ("absent", "failed")]
    assert list(rows) == ["good"] and rows["good"].count() == 1 and "no luck" in outcomes[1].reason and outcomes[3].reason == "no key"
    rows, outcomes = base.read_all(spark, made, only=["off"], shape=lambda df, n: df.withColumn("source", F.lit(n)))
    assert list(rows) == ["off"] and rows["off"].first().source == "off"


def test_paged_listing(spark):
    def fetch(prefix, offset, limit):
        have = [{"name": f"{prefix}{i}", "id": i or None, "size": i} for i in range(7)]
        return have[offset : offset + limit]

    spark.dataSource.register(base.paged_listing("flyers", fetch))
    rows = spark.read.format("flyers").option("prefixes", "a/,b/").option("page", "3").load()
    assert sorted(r.name for r in rows.collect()) == sorted(f"{p}{i}" for p in ("a/", "b/") for i in range(1, 7))


LD = '<script type="application/ld+json">{"@type":"Event","name":"Chess tournament","startDate":"2026-07-09","url":"https://x.org/e"}</script>'


def test_site_scan_one_level_deep(spark):
    none = (None, None, None)
    front = f'<a href="/events">Chess events</a><a href="/far">Chess calendar</a><a href="https://y.org/events">Chess events</a>{LD}'
    sites = spark.createDataFrame([("https://x.org/", front, "Here", None, None, None), ("https://z.org/", '<a href="/events">Chess events</a>', *none, False), ("https://w.org/", None, *none, None)], "url string, html string, site_location string, site_tribe string, hint string, follow boolean")
    deep = '<article><h2>Chess tournament at the lake</h2><p>The chess tournament begins on August 5, 2026 with an entry fee.</p></article><a href="/deeper">Chess events</a>'
    fetched = spark.createDataFrame([("https://x.org/events", deep), ("https://x.org/deeper", LD), ("https://z.org/events", deep), ("https://y.org/events", deep)], "url string, html string")
    got = sorted((r.title, str(r.start_date), r.location, r.confidence) for r in web.scan_sites(sites, fetched, AS_OF).collect())
    assert got == [("Chess tournament", "2026-07-09", "Here", 85), ("Chess tournament at the lake", "2026-08-05", "Here", 60)]


def test_search_pages(spark):
    plain = "<nav>May 1, 2027</nav><h2>Big <b>chess</b> day</h2><p>chess tournament on June 5, 2027 in Arlee, call 406-555-1234</p>"
    pages = [("https://a.org", LD, "s"), ("https://b.org", plain, "s"), ("https://c.org", "<p>nothing here</p>", "s"), ("https://d.org", "<p>chess tournament, some day</p>", "s"), ("https://e.org", None, "s")]
    got = {r.source_url: r for r in web.from_search_pages(spark.createDataFrame(pages, "url string, html string, snippet string"), AS_OF).collect()}
    assert sorted(got) == ["https://b.org", "https://x.org/e"]
    assert got["https://x.org/e"].confidence == 80
    b = got["https://b.org"]
    assert (b.title, b.start_date, b.confidence, b.details) == ("Big chess day", dt.date(2027, 6, 5), 50, "406-555-1234")

    hits = spark.createDataFrame([("chess 2026", 2, "https://a.org/2", "chess tournament"), ("chess 2026", 1, "https://a.org/1", "chess tournament"), ("chess 2027", 1, "https://a.org/2", "chess tournament"), ("chess 2027", 2, "https://SKIP.org/", "chess tournament"),
                                  ("chess 2027", 3, "https://a.org/3", "chess tournament"), ("other", 1, "https://a.org/4", "chess tournament"), ("chess 2026", 0, "https://a.org/5", "bread")], "query string, at int, url string, snippet string")
    skip = spark.createDataFrame([("skip.org",)], "host string")
    found = feeds.search_pages(["chess {year}"], [2026, 2027], hits, skip, k=2).collect()
    assert [(r.rank, r.url) for r in found] == [(1, "https://a.org/1"), (2, "https://a.org/2")]
    assert feeds.search_pages(["chess {year}"], [2026, 2027], hits, skip).count() == 3 and feeds.search_pages([], [2026], hits, skip).count() == 0
    assert feeds.forum_requests(["f", "g"], ["q"], spark).count() == 2


def test_ledger_files(spark, folder):
    where = f"file://{folder}/ledger"
    assert memory.load(spark, where).count() == 0
    stamp = dt.datetime(2026, 8, 12)
    one = spark.createDataFrame([("a", "t", AS_OF, "k", None, "s", "u", "queued", stamp, stamp)], LEDGER)
    memory.save(one, where)
    before = memory.load(spark, where)
    memory.save(before.unionByName(one.withColumn("fingerprint", F.lit("b"))), where)  # a plan may read what it replaces
    assert sorted(r.fingerprint for r in memory.load(spark, where).collect()) == ["a", "b"] and before.count() == 1
    for f in (folder / "ledger").glob("v-*/*.parquet"):
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.warns(UserWarning, match="starting empty"):
        assert memory.load(spark, where).count() == 0
    texts = spark.createDataFrame([(json.dumps({"schema": 1, "entries": {"f": {"title": "t", "start_date": "2026-07-09", "last_seen": "2026-01-02T03:04:05", "more": 1}}}),), ("{broken",), (None,)], "text string")
    row = memory.from_json_text(texts).collect()
    assert [(r.fingerprint, r.title, r.start_date, r.last_seen, r.phash) for r in row] == [("f", "t", dt.date(2026, 7, 9), dt.datetime(2026, 1, 2, 3, 4, 5), None)]


def test_review_pages_and_pending(spark, folder):
    rows = spark.range(23).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("fingerprint"), F.lit("</script> & x").alias("title"))
    pages = publish.review_pages(rows, [F.col("fingerprint")], {"queued": 23}, per_page=4).orderBy("page").collect()
    seen = []
    for p in pages:
        assert p.html.count("</script>") == 2 and p.n <= 4
        data = json.loads(p.html.split('id="data">')[1].split("</script>")[0])
        assert data["stats"] == {"queued": 23} and all(e["title"] == "</script> & x" for e in data["events"])
        seen += [e["fingerprint"] for e in data["events"]]
    assert seen == [f"{i:03}" for i in range(23)]
    publish.write_pending(rows, spark.range(1), rows, f"file://{folder}/pending")
    assert spark.read.json(f"file://{folder}/pending/queue").count() == 23


def test_publish_mirrors_and_backup(spark):
    rows = spark.createDataFrame([(k, "t", AS_OF, None, "l", None, None, f"https://x.org/{k}.png") for k in "abc"], "fingerprint string, title string, start_date date, end_date date, location string, tribe string, details string, flyer_url string")

    def mirror(row):
        if row["fingerprint"] == "b":
            raise OSError("no image")
        return f"https://own/{row['fingerprint']}"

    def send(row, approved):
        if not row["flyer_url"].startswith("https://own/") and row["fingerprint"] != "b":
            raise ValueError("not mirrored")

    got = publish.publish_summary(publish.publish(rows, send, mirror=mirror)).first()
    assert (got.added, got.failed, got.mirrored) == (3, 0, 2)

    bucket = spark.createDataFrame([("a", 1), ("b", 2)], "name string, size long")
    manifest = spark.createDataFrame([], "name string, size long, in_bucket boolean, first_backed_up timestamp, last_seen timestamp, gone_since timestamp")

    def copy(name):
        if name == "b":
            raise OSError("gone")

    found = reconcile.reconcile(manifest, bucket, dt.datetime(2026, 8, 12))
    settled = reconcile.settle(found, reconcile.back_up(found, copy))
    assert reconcile.summary(settled).first().asDict() == {"added": 1, "skipped": 0, "vanished": 0, "gone": 0, "failed": 1}
    again = reconcile.reconcile(settled.drop("action"), bucket, dt.datetime(2026, 8, 13))
    assert {r.name: r.action for r in again.collect()} == {"a": "skipped", "b": "added"}


def test_orders_and_states(spark):
    rows = spark.createDataFrame([(1, AS_OF, None), (2, None, dt.datetime(2026, 1, 1)), (3, AS_OF, dt.datetime(2026, 1, 2)), (4, dt.date(2026, 5, 1), None)], "id long, start_date date, created_at timestamp")
    ids = lambda which: [r.id for r in listing.ordered(rows, which).collect()]
    assert ids("upcoming") == [4, 1, 3, 2] and ids("past") == [3, 1, 4, 2] and ids("admin") == [3, 2, 4, 1]
    decisions = spark.createDataFrame([(1, "rejected", 1), (1, "approved", 2), (3, "odd", 5), (9, "approved", 1)], "id long, state string, decided_at int")
    assert {r.id: r.state for r in listing.review_state(rows, decisions).collect()} == {1: "approved", 2: "pending", 3: "pending", 4: "pending"}
    twice = spark.createDataFrame([(1, "b", 3), (1, "a", 4), (2, None, 1), (None, "x", 1)], "k int, at string, v int")
    assert {(r.k, r.at, r.v) for r in listing.first_of(twice, ["k"], ["at"]).collect()} == {(1, "a", 4), (2, None, 1), (None, "x", 1)}


def test_image_hashes_of_any_length(spark):
    left = spark.createDataFrame([("a", "0" * 32), ("b", "f" * 20), ("c", "0" * 10), ("d", "zz")], "l string, h string")
    right = spark.createDataFrame([("x", "0" * 29 + "fff"), ("y", "f" * 19 + "0"), ("z", "0" * 9 + "F"), ("w", "0" * 28 + "1fff")], "r string, h string")
    assert {(r.l, r.r, r.bits) for r in memory.near_hash_any(left, right, "l", "r", "h").collect()} == {("a", "x", 12), ("b", "y", 4), ("c", "z", 4)}
