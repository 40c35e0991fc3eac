"""More registered queries: records from text to queue, each beside SQL that says the same in other words."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..functions import vocab
from ..operators import collapse, enrich, linkage, memory
from ..schemas import LEDGER, RECORD
from ..session import ensure_checkpoints
from ..sources import feeds
from .queries import AS_OF, FEED_WORDS, STAMP, _iso, _table, order_listings, query


def _records(df):
    """df as records: columns that it lacks are null or empty."""
    have = dict(df.dtypes)
    blank = {"warnings": F.array(), "manual_fields": F.array(), "title_provisional": F.lit(False)}
    return df.select(*[(F.col(c) if c in have else blank.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in (x.split(" ") for x in RECORD.split(", "))])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'THE ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN length(w) <= 3 AND w <> lower(w) THEN upper(w) WHEN length(w) <= 3 AND regexp_matches(upper(w), '[A-Z]') THEN upper(w)
  ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') ELSE p_name END AS title, p_brand AS location, CASE WHEN p_partkey % 10 <= 4 THEN '1999-01-05' END AS end_date, CASE WHEN p_partkey % 10 <= 4 THEN 0 ELSE 1 END AS n_warnings FROM part""")
def tidy_records(spark, sf_dir):
    """Shouted titles softened, decoration gone, ends before starts dropped with a warning."""
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, F.concat(F.lit(" * THE\t"), F.upper("p_name"), F.lit(" |"))).otherwise(F.concat("p_name", F.lit("  ")))
    rows = _table(spark, sf_dir, "part").select(k.alias("ordinal"), title.alias("title"), F.concat(F.lit(" – "), "p_brand", F.lit(" -\n")).alias("location"), F.date_add(F.lit(AS_OF), (k % 10).cast("int")).alias("start_date"), F.date_add(F.lit(AS_OF), 4).alias("end_date"))
    return enrich.tidy(_records(rows)).select(F.col("ordinal").alias("id"), "title", "location", _iso("end_date"), F.size("warnings").alias("n_warnings"))


_SAID = "CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END"


@query(f"""SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start, concat_ws('|', CASE WHEN o_orderkey % 3 = 0 THEN 'the text says ' || dayname({_SAID}) || ', ' || monthname(o_orderdate) || ' ' || day(o_orderdate) || ', but in ' || year(o_orderdate) || ' that is a ' || dayname(o_orderdate) END,
CASE WHEN o_orderdate < DATE '1999-01-01' THEN '{dates.PAST}' END) AS warnings FROM orders""")
def weekday_warnings(spark, sf_dir):
    """Dates with a weekday before them, of which every third is the wrong one."""
    day = F.to_date("o_orderdate")
    said = F.date_add(day, F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0))
    text = F.concat(F.lit("Join us "), F.date_format(said, "EEEE"), F.lit(", "), F.date_format(day, "MMMM d, yyyy"), F.lit(" at noon"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.find_dates(text, AS_OF).alias("d"))
    return rows.select("id", _iso("d.start").alias("start"), F.array_join("d.warnings", "|").alias("warnings"))


@query("SELECT o_orderkey AS id, CAST(make_date(1999, month(o_orderdate), least(day(o_orderdate), 28)) AS VARCHAR) AS start FROM orders")
def inferred_years(spark, sf_dir):
    """A day without a year is the next one to come."""
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("Save the day: "), F.date_format(day, "MMMM "), F.least(F.dayofmonth(day), F.lit(28)).cast("string"), F.lit("!"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.find_dates(text, AS_OF)["start"].cast("string").alias("start"))


_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x, ' -–—|*•' || chr(9))), lambda x: length(x) BETWEEN 4 AND 90)"
_POINTS = r"""(CASE WHEN regexp_matches(lower(x), 'tournament|festival|concert|fair') THEN 300 ELSE 0 END + CASE WHEN regexp_matches(lower(x), 'tournament|tourney|memorial|annual') THEN 200 ELSE 0 END + CASE WHEN regexp_matches(x, '\d{4}') THEN 50 ELSE 0 END
 + CASE WHEN length(regexp_replace(x, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) > 0.7 * length(regexp_replace(x, '[^\p{L}]', '', 'g')) THEN 100 ELSE 0 END
 - 12 * (i - 1) - CASE WHEN regexp_matches(lower(x), '@|https?://|\bfacebook\b|\bcall\b|\btext\b') THEN 200 ELSE 0 END)"""


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents), s AS (SELECT doc_id, lines, list_sort(list_transform(lines[1:25], lambda x, i: {{'points': {_POINTS}, 'at': -i, 'line': x}}), 'DESC')[1] AS best FROM l)
SELECT doc_id, CASE WHEN best.points > 0 THEN best.line ELSE lines[1] END AS title FROM s""")
def guessed_titles(spark, sf_dir):
    """The most title-like line of every whole text, by the default vocabulary."""
    with vocab.using(vocab.Vocabulary()):
        return _table(spark, sf_dir, "documents").select("doc_id", T.guess_title(F.col("text")).alias("title"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'Washington' WHEN 1 THEN 'New Mexico' WHEN 2 THEN 'Idaho' WHEN 3 THEN 'Alberta' END AS state,
'hall ' || s_suppkey || ' ' || CASE s_suppkey % 6 WHEN 0 THEN 'washington' WHEN 1 THEN 'new mexico' WHEN 2 THEN 'idaho' WHEN 3 THEN 'alberta' WHEN 4 THEN 'zz' ELSE 'nowhere' END AS place FROM supplier""")
def place_keys(spark, sf_dir):
    """States by code or name in any case, and the key of a place: filler words gone, the code in last place spelled out."""
    k = F.col("s_suppkey")
    token = F.element_at(F.array(*[F.lit(x) for x in ("wa", "NEW MEXICO", "Id.", " alberta", "ZZ", "Nowhere")]), (k % 6 + 1).cast("int"))
    place = F.concat(F.lit("The Hall at "), k.cast("string"), F.lit(", near "), token)
    return _table(spark, sf_dir, "supplier").select(k.alias("id"), T.canonical_state(token).alias("state"), T.normalize_location(place).alias("place"))


@query("SELECT o_orderkey AS id, 'https://www.google.com/maps/search/?api=1&query=Hall%20' || o_custkey || '%2C%20Omak' AS link, substr('big prize ' || o_orderpriority || ' and more', 1, 20) AS snippet FROM orders")
def links_and_snippets(spark, sf_dir):
    place = F.concat(F.lit("Hall "), F.col("o_custkey").cast("string"), F.lit(", Omak"))
    text = F.concat(F.lit("  big\n prize "), "o_orderpriority", F.lit("\tand  more "))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.map_link(place).alias("link"), T.snippet(text, 20).alias("snippet"))


_ROUTED = """SELECT o_orderkey AS id, o_orderkey % 3 AS v, o_orderkey % 2 = 0 AS flagged, 'Order ' || o_orderpriority AS title, CAST(o_orderdate AS DATE) AS day FROM orders"""


@query(f"""SELECT id, CASE WHEN v = 0 AND flagged THEN 'flagged' WHEN v = 0 THEN 'live' ELSE 'queued' END AS disposition, CASE WHEN v = 0 AND flagged THEN 'community-flagged' WHEN v = 0 THEN 'already-on-site' ELSE 'queued' END AS outcome,
concat_ws('|', CASE WHEN v = 1 AND flagged THEN 'resembles an event that the community flagged: ''' || title || ''' on ' || day END, CASE WHEN v = 1 THEN 'close to an event on the site: ''' || title || ''' on ' || day || ' (75% match)' END) AS warnings FROM ({_ROUTED})""")
def routed_matches(spark, sf_dir):
    """What becomes of rows by the verdict on their best match, and the warnings that they get."""
    live = order_listings(spark, sf_dir)
    k = F.col("id")
    matches = live.select(k.cast("string").alias("fingerprint"), F.when(k % 3 == 0, "duplicate").when(k % 3 == 1, "possible").otherwise("new").alias("verdict"), F.when(k % 3 < 2, k).alias("id"),
                          F.when(k % 3 == 0, 0.95).when(k % 3 == 1, 0.755).alias("score"), F.when(k % 3 < 2, k % 2 == 0).alias("flagged"))
    rows = live.select(k.cast("string").alias("fingerprint"), F.array().cast("array<string>").alias("warnings"))
    return linkage.route(rows, matches, live).select(F.col("fingerprint").cast("long").alias("id"), "disposition", "outcome", F.array_join("warnings", "|").alias("warnings"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint, CAST(CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS start_date, o_orderkey % 100 AS confidence FROM orders ORDER BY CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END NULLS LAST, o_orderkey % 100 DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50")
def queue_head(spark, sf_dir):
    """The first page of a queue: the earliest day, the surest, and undated rows last."""
    k = F.col("id")
    rows = order_listings(spark, sf_dir).select(k.cast("string").alias("fingerprint"), F.when(k % 7 > 0, F.col("start_date")).alias("start_date"), (k % 100).alias("confidence"))
    return enrich.queue_order(rows).limit(50).select("fingerprint", _iso("start_date"), "confidence")


@query("""SELECT 'http://r.example/' || o_orderkey AS source_url, 'Tournament ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start_date, 'Omak, Washington' AS location,
CASE WHEN o_orderkey % 2 = 0 THEN 'http://i.example/' || o_orderkey || '.jpg' END AS flyer_url FROM orders WHERE o_orderkey % 5 > 0 AND (o_orderkey % 3 > 0 OR o_orderkey % 2 = 0)""")
def forum_posts(spark, sf_dir):
    """Orders as posts, each in two listings: off-topic ones go, a post counts once, and one without a date or an image is no record."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 > 0, "Tournament ").otherwise("Bingo ")
    text = F.concat(F.lit("Meet in Omak, WA"), F.when(k % 3 > 0, F.concat(F.lit(" on "), F.date_format("o_orderdate", "MMMM d, yyyy"))).otherwise(F.lit("")))
    image = F.when(k % 2 == 0, F.concat(F.lit("http://i.example/"), k.cast("string"), F.lit(".jpg"))).otherwise("http://r.example/gallery")
    post = F.struct(F.struct(k.cast("string").alias("id"), F.concat(name, k.cast("string")).alias("title"), text.alias("selftext"), F.concat(F.lit("http://r.example/"), k.cast("string")).alias("permalink"), image.alias("url")).alias("data"))
    body = F.to_json(F.struct(F.struct(F.array(post).alias("children")).alias("data")))
    none = F.lit(None).cast("string")
    bodies = _table(spark, sf_dir, "orders").select(F.lit("http://r.example/").alias("url"), body.alias("body"), none.alias("site_location"), none.alias("site_tribe"), none.alias("hint"))
    with vocab.using(FEED_WORDS):
        rows = feeds.from_posts(bodies.unionAll(bodies), AS_OF)
    return rows.select("source_url", "title", _iso("start_date"), "location", "flyer_url")


@query("SELECT CAST(doc_id AS VARCHAR) AS fingerprint, source AS title, lang AS outcome FROM documents")
def saved_ledger(spark, sf_dir):
    """A ledger that is saved twice, the second time with all rows, and loaded again."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    given = {"fingerprint": F.col("doc_id").cast("string"), "title": F.col("source"), "outcome": F.col("lang"), "first_seen": F.lit(STAMP), "last_seen": F.lit(STAMP)}
    rows = _table(spark, sf_dir, "documents").select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in (x.split(" ") for x in LEDGER.split(", "))])
    memory.save(rows.where("false"), folder)
    memory.save(rows, folder)
    return memory.load(spark, folder).select("fingerprint", "title", "outcome")


@query("SELECT source, doc_id FROM documents WHERE doc_id % 3 > 0 ORDER BY array_position(['src4', 'src2'], source) NULLS LAST, source, doc_id LIMIT 120")
def flyer_budget(spark, sf_dir):
    """The images that one run may fetch: 120 over all sources, in the order of the sources and of arrival."""
    rows = _table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("http://i.example/"), F.col("doc_id").cast("string"))).alias("flyer_url"))
    place = F.array_position(F.array(F.lit("src4"), F.lit("src2")), F.col("source"))
    return enrich.within_budget(rows, [F.nullif(place, F.lit(0).cast("long")).asc_nulls_last(), F.col("source"), F.col("doc_id")], 120).select("source", "doc_id")


_KINDS = ("off_topic", "incomplete", "past", "merged", "seen", "live", "flagged", "queued")


def _disposed(spark, sf_dir):
    k = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 8 + 1).cast("int"))
    return enrich.run_statistics(_table(spark, sf_dir, "documents").select("source", kind.alias("disposition"), F.array_repeat(F.lit("w"), F.when(k % 16 == 7, 1).otherwise(0)).alias("warnings")))


@query("SELECT count(*) AS collected, " + ", ".join(f"count(*) FILTER (doc_id % 8 = {i}) AS {x}" for i, x in enumerate(_KINDS)) + ", count(*) FILTER (doc_id % 16 = 7) AS needs_check FROM documents")
def run_dispositions(spark, sf_dir):
    """All dispositions of a run."""
    return _disposed(spark, sf_dir).drop("per_source")


@query("SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1")
def run_per_source(spark, sf_dir):
    return _disposed(spark, sf_dir).select(F.explode("per_source").alias("source", "n"))


@query("""WITH r AS (SELECT o_orderkey AS id, date_trunc('month', o_orderdate) AS m, o_custkey % 40 AS c, o_orderkey % 50 AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS details FROM orders),
w AS (SELECT *, first_value(id) OVER o AS first, max(confidence) OVER (PARTITION BY m, c) AS most, count(*) OVER (PARTITION BY m, c) AS n, bool_or(details IS NOT NULL) OVER (PARTITION BY m, c) AS filled
FROM r WINDOW o AS (PARTITION BY m, c ORDER BY confidence DESC, details IS NULL, id))
SELECT id, CASE WHEN id <> first THEN first END AS merged_into, CASE WHEN id = first THEN most ELSE confidence END AS confidence, CASE WHEN id = first THEN n - 1 ELSE 0 END AS n_warnings,
CASE WHEN id = first AND filled THEN 'x' ELSE details END AS details FROM w""")
def collapse_months(spark, sf_dir):
    """Orders of one of 40 kinds of customers in one month as one gathering: the first by rank takes in the others, so that SQL can say it too. Places are digests, of which no two are alike."""
    month = F.trunc("o_orderdate", "month")
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"), month.alias("start_date"), F.md5((F.col("o_custkey") % 40).cast("string").cast("binary")).alias("location"), F.lit("Open day").alias("title"), F.lit("orders").alias("source"),
        F.concat(F.lit("http://o.example/"), F.col("o_orderkey").cast("string")).alias("source_url"), (F.col("o_orderkey") % 50).cast("int").alias("confidence"), F.when(F.col("o_orderkey") % 2 == 0, "x").alias("details"),
    )
    out = collapse.collapse(_records(rows))
    return out.select(F.col("ordinal").alias("id"), "merged_into", F.col("confidence").cast("long").alias("confidence"), F.size("warnings").cast("long").alias("n_warnings"), "details")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Given' ELSE 'Spring tournament of ' || o_custkey || ' hands' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Here' ELSE 'Omak, Washington' END AS location,
CAST(CASE WHEN o_orderkey % 5 = 0 THEN DATE '2000-01-01' ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS start_date, CASE WHEN o_orderkey % 7 = 0 THEN 'bring 206-555-0142' ELSE '206-555-0142' END AS details FROM orders""")
def filled_records(spark, sf_dir):
    """Only blank fields are filled from a text; contacts that the details lack are added to them."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Spring tournament of "), F.col("o_custkey").cast("string"), F.lit(" hands\n"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("\nOmak, WA\ncall 206-555-0142"))
    rows = _table(spark, sf_dir, "orders").select(k.alias("ordinal"), F.when(k % 2 == 0, "Given").otherwise("").alias("title"), F.when(k % 3 == 0, "Here").alias("location"), F.when(k % 5 == 0, F.lit("2000-01-01").cast("date")).alias("start_date"),
                                                  F.when(k % 7 == 0, "bring 206-555-0142").alias("details"), text.alias("raw_text"))
    with vocab.using(FEED_WORDS):
        out = enrich.fill_from_text(_records(rows), AS_OF, "ocr")
    return out.select(F.col("ordinal").alias("id"), "title", "location", _iso("start_date"), "details")
