"""Registered queries: each operator over whole tables, beside the SQL that gives the same rows.

The tables hold orders, texts and pages rather than announcements, so each query first says which columns stand for which fields.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fuzzy, hashing, vocab
from ..functions import text as T
from ..operators import enrich, linkage, listing, live_match, memory, publish, reconcile
from ..sources import feeds, inbox, web
from ..streaming import state

AS_OF = dt.date(1999, 1, 1)
STAMP = dt.datetime(2026, 8, 12)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iso(c: str):
    return F.col(c).cast("string").alias(c)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings of up to four days."""
    day = F.to_date("o_orderdate")
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("title"), day.alias("start_date"),
        F.date_add(day, (F.col("o_orderkey") % 4).cast("int")).alias("end_date"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("location"),
        F.col("o_orderstatus").alias("tribe"), F.lit(None).cast("string").alias("details"), (F.col("o_orderkey") % 5).cast("int").alias("report_count"),
        F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False).alias("approved"), F.col("o_totalprice").alias("price"),
    )


_L = """WITH l AS (SELECT o_orderkey AS id, 'Order ' || o_orderpriority AS title, CAST(o_orderdate AS DATE) AS start_date,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS end_date, 'Customer ' || o_custkey AS location, o_orderstatus AS tribe, o_orderkey % 5 AS report_count,
  CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS approved, o_totalprice AS price FROM orders)
"""


@query(_L + "SELECT id, title, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, location FROM l WHERE report_count < 3 AND start_date >= DATE '1999-01-01'")
def listing_upcoming(spark, sf_dir):
    return listing.upcoming(listing.visible(order_listings(spark, sf_dir)), AS_OF).select("id", "title", _iso("start_date"), _iso("end_date"), "location")


@query(_L + "SELECT id, title, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, location FROM l WHERE report_count < 3 AND (start_date IS NULL OR start_date < DATE '1999-01-01')")
def listing_past(spark, sf_dir):
    return listing.past(listing.visible(order_listings(spark, sf_dir)), AS_OF).select("id", "title", _iso("start_date"), _iso("end_date"), "location")


@query(_L + "SELECT id, title, CAST(start_date AS VARCHAR) AS start_date FROM l WHERE report_count < 3 AND l.start_date >= DATE '1999-01-01' ORDER BY l.start_date, id LIMIT 3")
def listing_page(spark, sf_dir):
    rows = listing.upcoming(listing.visible(order_listings(spark, sf_dir)), AS_OF)
    return listing.page(rows, 1, [F.col("start_date"), F.col("id")]).select("id", "title", _iso("start_date"))


@query(_L + "SELECT id, tribe, CAST(ceil(row_number() OVER (PARTITION BY location ORDER BY start_date, id) / 3.0) AS INTEGER) AS page FROM l")
def listing_page_numbers(spark, sf_dir):
    return listing.page_numbers(order_listings(spark, sf_dir), ["location"], [F.col("start_date"), F.col("id")]).select("id", "tribe", "page")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(coalesce(text, '')), 'the and')")
def keyword_search(spark, sf_dir):
    return listing.search(_table(spark, sf_dir, "documents"), "The And", ("text",)).select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), '1') OR contains(lower(coalesce(p_brand, '')), '1')")
def keyword_search_parts(spark, sf_dir):
    return listing.search(_table(spark, sf_dir, "part"), "1", ("p_name", "p_brand")).select("p_partkey", "p_name")


@query(_L + "SELECT count(*) AS n, count(*) || ' upcoming event' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS label FROM l WHERE start_date >= DATE '1999-01-01'")
def listing_count(spark, sf_dir):
    return listing.count_text(listing.upcoming(order_listings(spark, sf_dir), AS_OF), "upcoming")


@query(_L + """, d AS (SELECT id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM l WHERE end_date >= start_date)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM d WHERE day >= DATE '1997-03-01' AND day < DATE '1997-04-01' GROUP BY day""")
def calendar_days(spark, sf_dir):
    return listing.calendar_days(order_listings(spark, sf_dir), dt.date(1997, 3, 1)).select(_iso("day"), "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT o_orderkey AS id, CAST((isodow(date_trunc('month', o_orderdate)) % 7) AS INTEGER) AS lead, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days FROM orders")
def month_grid(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), listing.month_grid(F.to_date("o_orderdate")).alias("g")).select("id", "g.lead", "g.days")


@query(_L + """SELECT 'pending' AS which, count(*) AS n FROM l WHERE NOT coalesce(approved, false) UNION ALL SELECT 'reported', count(*) FROM l WHERE report_count > 0
UNION ALL SELECT 'approved', count(*) FROM l WHERE approved UNION ALL SELECT 'all', count(*) FROM l""")
def admin_counts(spark, sf_dir):
    rows, out = order_listings(spark, sf_dir), None
    for which in ("pending", "reported", "approved", "all"):
        part = listing.admin_view(rows, which).agg(F.count(F.lit(1)).alias("n")).select(F.lit(which).alias("which"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(_L + """SELECT DISTINCT s.id AS sub_id, l.id FROM l AS s JOIN l ON s.start_date = l.start_date
  AND (lower(l.location) LIKE lower('%' || s.location || '%') OR lower(l.title) LIKE lower('%' || s.title || '%'))""")
def submit_dup_probe(spark, sf_dir):
    rows = order_listings(spark, sf_dir)
    return listing.likely_duplicates(rows.withColumnRenamed("id", "sub_id"), rows)


@query(_L + "SELECT l.id, (m.id IS NOT NULL) AS reported_by_me FROM l LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R') m ON l.id = m.id")
def mark_reported(spark, sf_dir):
    mine = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return listing.mark_reported(order_listings(spark, sf_dir), mine).select("id", "reported_by_me")


_STRONG, _SUPPORT, _NEGATIVE = ["thtion", "licensed"], ["the", "and", "und", "les", "que"], ["worthless", "|"]
_TOPIC = "(CASE WHEN trim(t) = '' THEN 0 WHEN ({n}) AND NOT ({s}) THEN 0 ELSE (CASE WHEN {s} THEN 7 ELSE 0 END) + least(3, {h}) END)".format(
    n=" OR ".join(f"contains(t, '{w}')" for w in _NEGATIVE), s=" OR ".join(f"contains(t, '{w}')" for w in _STRONG), h=" + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in _SUPPORT)
)


def _doc_topic(text):
    return T.topic_tenths(text, None, _STRONG, _SUPPORT, _NEGATIVE)


@query(f"SELECT doc_id, {_TOPIC} AS tenths FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def topic_score(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", _doc_topic(F.col("text")).alias("tenths"))


@query(f"""SELECT source, count(*) AS n, count(*) FILTER (d = 'off_topic') AS off_topic, count(*) FILTER (d = 'incomplete') AS incomplete, count(*) FILTER (d = 'past') AS past, count(*) FILTER (d = 'keep') AS keep
FROM (SELECT source, CASE WHEN {_TOPIC} < 5 THEN 'off_topic' WHEN doc_id % 7 = 0 THEN 'incomplete' WHEN DATE '1999-01-01' + CAST(doc_id % 100 - 50 AS INTEGER) < DATE '1999-01-01' THEN 'past' ELSE 'keep' END AS d
FROM (SELECT doc_id, source, lower(coalesce(text, '')) AS t FROM documents)) GROUP BY source""")
def disposition_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(
        "source", _doc_topic(F.col("text")).alias("topic"), F.lit("x").alias("title"), F.when(F.col("doc_id") % 7 != 0, "here").alias("location"),
        F.date_add(F.lit(AS_OF), (F.col("doc_id") % 100 - 50).cast("int")).alias("start_date"), F.lit(None).cast("date").alias("end_date"),
    )
    rows = rows.withColumn("d", enrich.disposition(AS_OF, F.col("topic")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("d") == k).alias(k) for k in ("off_topic", "incomplete", "past", "keep")])


_KEY = "trim(" + "regexp_replace(" * len(T.key_steps()) + "lower(coalesce(x, ''))" + "".join(f", '{p}', '{r}', 'g')" for p, r in T.key_steps()) + ")"


@query(f"SELECT doc_id, sha1(key) AS key_sha1, length(key) AS n FROM (SELECT doc_id, {_KEY} AS key FROM (SELECT doc_id, text AS x FROM documents))")
def normalize_key_docs(spark, sf_dir):
    key = T.normalize_key(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).select("doc_id", F.sha1(F.col("key").cast("binary")).alias("key_sha1"), F.length("key").cast("long").alias("n"))


@query(r"SELECT doc_id, nullif(array_to_string(list_distinct_in_order[1:4], ', '), '') AS contact FROM (SELECT doc_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_in_order FROM "
       r"(SELECT doc_id, list_concat(regexp_extract_all(text, '(?:\(\d{3}\)\s*|\b\d{3}[-.\s])\d{3}[-.\s]\d{4}\b'), regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b')) AS m FROM documents))")
def contact_extract(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.find_contact(F.col("text")).alias("contact"))


_PLACES = "s_suppkey AS id, 'Hall ' || s_suppkey || ', Town in ' || substr(s_name, 1, 8) || ', ' || CASE s_nationkey % 5 WHEN 0 THEN 'WA' WHEN 1 THEN 'New Mexico' WHEN 2 THEN 'id' WHEN 3 THEN 'West Virginia' ELSE 'Nowhere' END AS place"


@query(f"SELECT id, CASE WHEN place LIKE '%, WA' THEN 'Washington' WHEN place LIKE '%New Mexico' THEN 'New Mexico' WHEN place LIKE '%, id' THEN 'Idaho' WHEN place LIKE '%West Virginia' THEN 'Virginia' END AS state FROM (SELECT {_PLACES} FROM supplier)".replace("THEN 'Virginia'", "THEN 'West Virginia'"))
def location_state(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", _PLACES.partition(", ")[2])
    return rows.select("id", T.location_state(F.col("place")).alias("state"))


@query(f"SELECT page_id, substr(sha1(coalesce(url, '') || '|' || {_KEY.replace('coalesce(x', 'coalesce(url')} || '||'), 1, 16) AS fingerprint FROM pages")
def fingerprint_pages(spark, sf_dir):
    none = F.lit(None)
    return _table(spark, sf_dir, "pages").select("page_id", hashing.fingerprint(F.col("url"), F.col("url"), none.cast("date"), none.cast("string")).alias("fingerprint"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ledger_antijoin(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fingerprint"), "source")
    return memory.unseen(docs, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fingerprint"))).select(F.col("fingerprint").alias("doc_id"), "source")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedupe(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256), F.length("text")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


_SIGNS = "SELECT vec_id, list_reduce(list_transform(embedding[1:64], lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS UBIGINT) << (64 - i) ELSE CAST(0 AS UBIGINT) END), lambda a, b: a + b) AS h FROM embeddings"


@query(f"WITH s AS ({_SIGNS}) SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS bits FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 12")
def near_hash_join(spark, sf_dir):
    digit = lambda k: F.conv(F.array_join(F.transform(F.slice("embedding", 4 * k + 1, 4), lambda x: F.when(x > 0, "1").otherwise("0")), ""), 2, 16)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.concat(*[digit(k) for k in range(16)]).alias("h"))
    pairs = memory.near_hash_short(rows.withColumnRenamed("vec_id", "a_id"), rows.withColumnRenamed("vec_id", "b_id"), "a_id", "b_id", "h", max_bits=12)
    return pairs.where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("bits").cast("long").alias("bits"))


@query(_L + """SELECT a.id AS a, b.id AS b, CASE abs(a.start_date - b.start_date) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END AS proximity
FROM l a JOIN l b ON a.location = b.location AND a.id < b.id AND abs(a.start_date - b.start_date) <= 3""")
def date_proximity_join(spark, sf_dir):
    rows = order_listings(spark, sf_dir).select("id", "start_date", "location")
    near = F.explode(F.sequence(F.date_sub("start_date", 3), F.date_add("start_date", 3)))
    l = rows.select(F.col("id").alias("a"), F.col("start_date").alias("l_start"), "location", near.alias("day"))
    r = rows.select(F.col("id").alias("b"), F.col("start_date").alias("day"), "location")
    return l.join(r, ["location", "day"]).where("a < b").select("a", "b", fuzzy.date_proximity(F.col("l_start"), F.col("day")).alias("proximity"))


def dated_documents(spark, sf_dir):
    """Documents as records: the likeliest title of the whole text, the source as a place, the day of the order with the same number (none where there is no such order)."""
    none = lambda k: F.lit(None).cast(k)
    days = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("start_date"))
    docs = _table(spark, sf_dir, "documents").withColumn("title", T.guess_title(F.col("text"))).join(days, "doc_id", "left")
    return docs.select(
        "title", "start_date", none("date").alias("end_date"), F.concat(F.lit("Customer "), F.regexp_replace("source", "[^0-9]", ""), F.lit("00")).alias("location"), none("string").alias("tribe"), none("string").alias("details"),
        none("string").alias("flyer_url"), "source", F.concat(F.lit("http://example.com/"), "doc_id").alias("source_url"), none("string").alias("flyer_phash"),
        (F.col("n_chars") % 100).cast("int").alias("confidence"), F.array().cast("array<string>").alias("warnings"), none("string").alias("raw_text"), F.col("doc_id").alias("ordinal"),
    )


def _match_tables(spark, sf_dir):
    new = dated_documents(spark, sf_dir).withColumn("fingerprint", F.col("ordinal").cast("string"))
    live = order_listings(spark, sf_dir).select("id", "title", "location", "start_date", F.lit(None).cast("string").alias("flyer_phash"), (F.col("report_count") >= 3).alias("flagged"))
    return new, live


@query()
def best_live_match(spark, sf_dir):
    """Rows only: common subsequences have no counterpart in SQL; tests hold it against a brute-force version."""
    return linkage.best_live_match(*_match_tables(spark, sf_dir))


#: A likeness by edits, and a pair's score, as SQL says them.
_EDIT = "CASE WHEN c.{0} <> '' AND l.{0} <> '' THEN 1 - levenshtein(c.{0}, l.{0}) / CAST(greatest(length(c.{0}), length(l.{0})) AS DOUBLE) END"


@query(f"""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(c_mktsegment[1:2]) || CASE c_nationkey % 4 WHEN 0 THEN 'ed widget' WHEN 1 THEN 'all rings' WHEN 2 THEN 'ue bolts' ELSE 'een gear' END END AS title,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'lane ' || c_nationkey END AS place, CASE WHEN c_custkey % 20 > 0 THEN DATE '1995-01-01' + CAST(c_custkey * 7 % 500 AS INTEGER) END AS day, CASE WHEN c_custkey % 5 = 0 THEN 'i' || c_custkey % 400 END AS image FROM customer),
l AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS title, 'lane ' || p_size AS place, CASE WHEN p_partkey % 25 > 0 THEN DATE '1995-01-01' + CAST(p_partkey % 500 AS INTEGER) END AS day, CASE WHEN p_partkey % 40 = 0 THEN 'i' || p_partkey % 400 END AS image FROM part),
p AS (SELECT c.id AS c_id, l.id, l.day, abs(c.day - l.day) AS gap, c.image = l.image AS twin, {_EDIT.format("title")} AS t, {_EDIT.format("place")} AS p FROM c JOIN l ON c.day IS NULL OR l.day IS NULL OR abs(c.day - l.day) <= 7),
d AS (SELECT *, CASE gap WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.55::DOUBLE WHEN 3 THEN 0.55::DOUBLE ELSE CASE WHEN gap IS NOT NULL THEN 0.25::DOUBLE END END AS d FROM p),
m AS (SELECT *, (coalesce(0.45::DOUBLE * d, 0) + coalesce(0.30::DOUBLE * p, 0) + coalesce(0.25::DOUBLE * t, 0)) / nullif(CASE WHEN d IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN p IS NULL THEN 0 ELSE 0.30::DOUBLE END + CASE WHEN t IS NULL THEN 0 ELSE 0.25::DOUBLE END, 0) AS mean FROM d),
s AS (SELECT *, CASE WHEN twin THEN 1.0::DOUBLE ELSE CAST(round(CAST(coalesce(CASE WHEN d >= 0.85 AND p >= 0.85 THEN greatest(mean, 0.92::DOUBLE) ELSE mean END, 0) AS DECIMAL(18, 12)), 3) AS DOUBLE) END AS score FROM m),
b AS (SELECT c_id, id, score FROM s WHERE score >= 0.72 QUALIFY row_number() OVER (PARTITION BY c_id ORDER BY score DESC, day DESC NULLS LAST, id) = 1)
SELECT CAST(c.id AS VARCHAR) AS fingerprint, b.id, b.score, CASE WHEN b.score >= 0.9 THEN 'duplicate' WHEN b.score >= 0.72 THEN 'possible' ELSE 'new' END AS verdict FROM c LEFT JOIN b ON c.id = b.c_id""")
def best_live_match_edit(spark, sf_dir):
    """best_live_match by edit distance, which SQL has: customers as candidates, parts as the site, a part of both without a day, title or place, and images in common."""
    k, p = F.col("c_custkey"), F.col("p_partkey")
    day = lambda ok, n: F.when(ok, F.date_add(F.lit("1995-01-01").cast("date"), (n % 500).cast("int")))
    ends = F.array(*[F.lit(x) for x in ("ed widget", "all rings", "ue bolts", "een gear")])
    new = _table(spark, sf_dir, "customer").select(
        k.cast("string").alias("fingerprint"), F.when(k % 11 != 0, F.concat(F.substr("c_mktsegment", F.lit(1), F.lit(2)), F.get(ends, (F.col("c_nationkey") % 4).cast("int")))).alias("title"),
        F.when(k % 13 != 0, F.concat(F.lit("Lane "), F.col("c_nationkey").cast("string"))).alias("location"), day(k % 20 > 0, k * 7).alias("start_date"), F.when(k % 5 == 0, F.concat(F.lit("i"), (k % 400).cast("string"))).alias("flyer_phash"))
    live = _table(spark, sf_dir, "part").select(
        p.alias("id"), F.when(p % 17 != 0, F.col("p_name")).alias("title"), F.concat(F.lit("Lane "), F.col("p_size").cast("string")).alias("location"), day(p % 25 > 0, p).alias("start_date"),
        F.when(p % 40 == 0, F.concat(F.lit("i"), (p % 400).cast("string"))).alias("flyer_phash"), F.lit(False).alias("flagged"))
    return live_match.best_live_match(new, live, live_match.EDITS).select("fingerprint", "id", "score", "verdict")


@query()
def fuzzy_collapse(spark, sf_dir):
    """Rows only: greedy merging depends on its order; tests hold it against one loop over all rows."""
    return linkage.collapse(dated_documents(spark, sf_dir)).select("ordinal", "merged_into", "title", "confidence", F.size("warnings").alias("n_warnings"))


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def outcome_histogram(spark, sf_dir):
    return memory.outcome_histogram(_table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")))


@query("SELECT CAST(event_id AS VARCHAR) AS fingerprint, epoch_us(ts) AS last_seen FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 15")
def top_recent(spark, sf_dir):
    return memory.most_recent(_table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("fingerprint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last_seen")))


@query("SELECT user_id % 40 AS event, count(DISTINCT event_type || '/' || user_id) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type || '/' || user_id) >= 3")
def report_threshold(spark, sf_dir):
    reports = _table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("client"), (F.col("user_id") % 40).alias("event"))
    return state.hidden_events(reports)


@query("""WITH RECURSIVE a AS (SELECT user_id AS client, (epoch_us(ts) // 1000) AS ms, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events WHERE event_type = 'signup'),
r AS (SELECT client, ms, seq, i, true AS accepted, [ms] AS recent FROM a WHERE i = 1
UNION ALL SELECT a.client, a.ms, a.seq, a.i, len(list_filter(r.recent, lambda x: a.ms - x < 3600000)) < 3,
  CASE WHEN len(list_filter(r.recent, lambda x: a.ms - x < 3600000)) < 3 THEN list_append(list_filter(r.recent, lambda x: a.ms - x < 3600000), a.ms) ELSE list_filter(r.recent, lambda x: a.ms - x < 3600000) END
FROM r JOIN a ON a.client = r.client AND a.i = r.i + 1)
SELECT client, ms, seq, accepted FROM r""")
def rate_limited_submits(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").where("event_type = 'signup'")
    return state.rate_limited(rows.select(F.col("user_id").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq")))


@query("""WITH e AS (SELECT user_id AS host, event_id AS seq, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status FROM events),
w AS (SELECT *, sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) OVER o AS hits, sum(CASE WHEN status = 429 THEN 0 ELSE 1 END) OVER o AS runs FROM e WINDOW o AS (PARTITION BY host ORDER BY seq)),
x AS (SELECT *, sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) OVER (PARTITION BY host, runs ORDER BY seq) AS row_n FROM w)
SELECT host, seq, least(30.0, 2.0 * pow(2.0, least(hits, 10)))::DOUBLE AS delay_s, bool_or(row_n >= 3) OVER (PARTITION BY host ORDER BY seq) AS dropped FROM x""")
def host_breaker(spark, sf_dir):
    answers = _table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"), F.lit(None).cast("double").alias("retry_after"))
    return state.host_breaker(answers).select("host", "seq", "delay_s", "dropped")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS name, d.doc_id IS NOT NULL AS in_bucket,
CASE WHEN d.doc_id IS NULL THEN 'vanished' WHEN l.doc_id IS NOT NULL AND l.quality = d.n_chars % 2 THEN 'skipped' ELSE 'added' END AS action
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def reconcile_inventory(spark, sf_dir):
    stamp = F.lit(STAMP)
    manifest = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("long").alias("size"), F.lit(True).alias("in_bucket"), stamp.alias("first_backed_up"), stamp.alias("last_seen"), F.lit(None).cast("timestamp").alias("gone_since"))
    bucket = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), (F.col("n_chars") % 2).alias("size"))
    return reconcile.reconcile(manifest, bucket, STAMP).select("name", "in_bucket", "action")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages")
def page_titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"))


@query()
def page_links(spark, sf_dir):
    """Rows only: links are resolved against the page's address."""
    return web.promising_links(_table(spark, sf_dir, "pages"), k=20, least=-4)


@query()
def page_blocks(spark, sf_dir):
    """Rows only: needs an HTML parser; tests hold it against fixed pages."""
    rows = _table(spark, sf_dir, "pages").select("page_id", F.explode(web.parse_blocks(F.col("html"))).alias("b"))
    return rows.select("page_id", "b.heading", "b.link", F.length("b.text").alias("n_chars"), F.sha1(F.col("b.text").cast("binary")).alias("text_sha1"), "b.whole")


_STRIP = "regexp_replace(" * 11 + "html" + "".join(f", '{p}', '{r}', 'g')" for p, r in (("<[^>]+>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&#0?39;|&apos;|&#8217;", "''"), ("&nbsp;|&#160;", " "), ("&#8211;", "–"), ("&#0?38;|&amp;?", "&"), (r"\s+", " ")))


@query(f"SELECT page_id, sha1(trim({_STRIP})) AS text_sha1 FROM pages")
def html_strip(spark, sf_dir):
    """Entities as SQL knows them: but for &amp none without its semicolon."""
    return _table(spark, sf_dir, "pages").select("page_id", F.sha1(T.strip_html(F.col("html"), whole=True).cast("binary")).alias("text_sha1"))


@query("""SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start, CASE WHEN day(o_orderdate) <= 26 THEN CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR) END AS "end" FROM orders""")
def date_extract(spark, sf_dir):
    """Dates come back from sentences that are made of them."""
    day, d = F.to_date("o_orderdate"), F.dayofmonth("o_orderdate")
    text = F.when(d <= 26, F.concat(F.lit("Doors 5:00 PM, "), F.date_format(day, "MMMM "), d.cast("string"), F.lit("-"), (d + 2).cast("string"), F.date_format(day, ", yyyy"))).otherwise(F.date_format(day, "'on' MMM d, yyyy"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.find_dates(text, AS_OF).alias("d"))
    return rows.select("id", _iso("d.start").alias("start"), _iso("d.end").alias("end"))


@query("""SELECT o_orderkey AS id, greatest(0, least(100, 35 + CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END + 10 + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 5 ELSE 0 END
  + 2 * (o_orderkey % 11) + CASE WHEN o_orderkey % 4 = 0 THEN 5 WHEN o_orderkey % 4 = 1 THEN -5 ELSE 0 END - 7 * (o_orderkey % 3))) AS hundredths FROM orders""")
def confidence_score(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n: F.when(k % n == 0, "x")
    rows = _table(spark, sf_dir, "orders").select(
        k.alias("id"), F.to_date("o_orderdate").alias("start_date"), some(2).alias("location"), F.lit("x").alias("title"), some(3).alias("flyer_url"), some(5).alias("tribe"),
        F.when(k % 4 == 0, "structured").when(k % 4 == 1, "ocr").otherwise("manual").alias("extraction"), F.array_repeat(F.lit("w"), (k % 3).cast("int")).alias("warnings"), (k % 11).alias("topic"),
    )
    return rows.select("id", enrich.confidence(F.col("topic")).alias("hundredths"))


@query("""SELECT conv_id, count(*) AS turns, sha1(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_sha1 FROM conversations GROUP BY conv_id""")
def conversation_rollup(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("all"))
    return rows.select("conv_id", "turns", F.sha1(F.array_join(F.transform("all", lambda x: x.text), "\n").cast("binary")).alias("text_sha1"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%a, %B %-d, %Y') || CASE WHEN o_orderkey % 4 > 0 THEN ' – ' || strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER), '%a, %B %-d, %Y') ELSE '' END AS shown FROM orders")
def display_ranges(spark, sf_dir):
    return order_listings(spark, sf_dir).select("id", T.display_range(F.col("start_date"), F.col("end_date")).alias("shown"))


@query("SELECT doc_id, sha1(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS html_sha1 FROM documents")
def escape_docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.escape_html(F.col("text")).cast("binary")).alias("html_sha1"))


FEED_WORDS = vocab.Vocabulary(strong=["tournament"])


def _bodies(rows: DataFrame, body) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.concat(F.lit("http://feed.example/"), F.col("o_orderkey").cast("string")).alias("url"), body.alias("body"), none.alias("site_location"), F.lit("site").alias("site_tribe"), none.alias("hint"))


@query("""SELECT 'Tournament, ' || o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date,
CASE WHEN o_orderkey % 4 > 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS VARCHAR) END AS end_date, 'Hall; ' || o_custkey AS location, 'http://feed.example/' || o_orderkey AS source_url FROM orders""")
def ics_feed(spark, sf_dir):
    """Orders as iCal bodies with folded lines, parameters and escapes, read back."""
    day = F.to_date("o_orderdate")
    stamp = lambda d: F.date_format(d, "yyyyMMdd")
    body = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Tournament\\, \r\n "), F.col("o_orderpriority"), F.lit("\r\nDTSTART;VALUE=DATE:"), stamp(day), F.lit("\r\nDTEND:"),
        stamp(F.date_add(day, (F.col("o_orderkey") % 4).cast("int"))), F.lit("T120000\r\nDTSTART:20200101\r\nLOCATION:Hall\\; "), F.col("o_custkey").cast("string"),
        F.lit("\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:Bingo\r\nDTSTART:20200101\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    with vocab.using(FEED_WORDS):
        rows = feeds.from_ics(_bodies(_table(spark, sf_dir, "orders"), body))
    return rows.select("title", _iso("start_date"), _iso("end_date"), "location", "source_url")


@query("""SELECT 'Tournament & ' || o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, 'Hall ' || o_custkey || ', WA' AS location, 'site' AS tribe, 'big prize' AS details,
'http://i.example/' || o_orderkey || '.jpg' AS flyer_url, CASE WHEN o_orderkey % 2 = 0 THEN 'http://e.example/' || o_orderkey ELSE 'http://feed.example/' || o_orderkey END AS source_url FROM orders""")
def json_feed(spark, sf_dir):
    """Orders as event JSON, read back: entities decoded, the venue joined, the image an object or a text, off-topic events gone."""
    k = F.col("o_orderkey").cast("string")
    picture = F.concat(F.lit("http://i.example/"), k, F.lit(".jpg"))
    image = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"url":"'), picture, F.lit('"}'))).otherwise(F.concat(F.lit('"'), picture, F.lit('"')))
    url = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"url":"http://e.example/'), k, F.lit('",'))).otherwise("")
    body = F.concat(F.lit('{"events":[{"title":"Tournament &#038; '), F.col("o_orderpriority"), F.lit('",'), url, F.lit('"description":"<p>big <b>prize</b></p>","start_date":"'), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
                    F.lit('","image":'), image, F.lit(',"venue":{"venue":"Hall '), F.col("o_custkey").cast("string"), F.lit('","city":"","state":"WA"}},{"title":"Bingo"}]}'))
    with vocab.using(FEED_WORDS):
        rows = feeds.from_event_json(_bodies(_table(spark, sf_dir, "orders"), body))
    return rows.select("title", _iso("start_date"), "location", "tribe", "details", "flyer_url", "source_url")


@query("""SELECT page_id, coalesce(nullif(concat_ws('; ', CASE WHEN page_id % 3 = 0 THEN 'title is missing' END, CASE WHEN page_id % 5 = 0 THEN 'start date is missing' END, CASE WHEN page_id % 4 = 1 THEN 'location is missing' END,
CASE WHEN page_id % 5 > 0 AND page_id % 7 = 0 THEN 'ends before it starts' END, CASE WHEN NOT regexp_matches(url, '^(?i)https://[^/\\s]+/\\S+') THEN 'flyer is no https address with a path' END), ''), '') AS errors FROM pages""")
def form_checks(spark, sf_dir):
    k, day = F.col("page_id"), F.lit(AS_OF)
    rows = _table(spark, sf_dir, "pages").select(
        "page_id", F.when(k % 3 != 0, "x").otherwise(" ").alias("title"), F.when(k % 5 != 0, day).alias("start_date"), F.when(k % 4 != 1, "here").alias("location"),
        F.when(k % 7 == 0, F.date_sub(day, 1)).otherwise(day).alias("end_date"), F.col("url").alias("flyer_url"))
    return listing.form_errors(rows).select("page_id", F.array_join("errors", "; ").alias("errors"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^(?i)https?://') THEN url ELSE '' END AS safe, CASE WHEN page_id % 101 >= 75 THEN 'hi' WHEN page_id % 101 >= 50 THEN 'mid' ELSE 'lo' END AS badge FROM pages""")
def safe_urls_and_badges(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.safe_url(F.col("url")).alias("safe"), T.confidence_badge(F.col("page_id") % 101).alias("badge"))


@query("SELECT count(*) FILTER (event_type NOT IN ('view', 'click')) AS pending, count(*) FILTER (event_type = 'view') AS approved, count(*) FILTER (event_type = 'click') AS rejected FROM events")
def review_tally(spark, sf_dir):
    state_ = F.when(F.col("event_type") == "view", "approved").when(F.col("event_type") == "click", "rejected").otherwise(F.col("event_type"))
    return listing.review_tally(_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), state_.alias("state")))


@query(_L + """SELECT l.id, coalesce(u.approved, l.approved) AS approved FROM l LEFT JOIN (SELECT l_orderkey AS id, bool_or(l_returnflag = 'A') AS approved FROM lineitem GROUP BY 1) u ON l.id = u.id
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.id)""")
def admin_changes(spark, sf_dir):
    updates = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "A").alias("approved"))
    gone = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return publish.apply_admin(order_listings(spark, sf_dir), updates, gone).select("id", "approved")


@query(_L + "SELECT id FROM l WHERE NOT (start_date < DATE '1999-01-01' - 900)")
def ledger_prune(spark, sf_dir):
    return memory.prune(order_listings(spark, sf_dir), AS_OF).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = o_orderkey)")
def ledger_forget(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fingerprint"))
    return memory.forget(rows, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fingerprint"))).select(F.col("fingerprint").alias("id"))


@query("""WITH new AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS source, lang AS outcome FROM documents)
SELECT CAST(coalesce(o.doc_id, n.doc_id) AS VARCHAR) AS fingerprint, coalesce(n.source, CASE WHEN o.doc_id IS NOT NULL THEN 'old' END) AS source, coalesce(n.outcome, CASE WHEN o.doc_id IS NOT NULL THEN 'queued' END) AS outcome,
CASE WHEN o.doc_id IS NULL THEN '2026-08-12' ELSE '1999-01-01' END AS first_seen, CASE WHEN n.doc_id IS NULL THEN '1999-01-01' ELSE '2026-08-12' END AS last_seen
FROM (SELECT DISTINCT doc_id FROM labels) o FULL JOIN new n ON o.doc_id = n.doc_id""")
def ledger_upsert(spark, sf_dir):
    """Labels as the ledger, documents as what is new: first_seen stays, blanks keep what was there, the outcome is replaced."""
    none, then = F.lit(None).cast("string"), F.lit(dt.datetime(1999, 1, 1))
    ledger = _table(spark, sf_dir, "labels").select("doc_id").distinct().select(
        F.col("doc_id").cast("string").alias("fingerprint"), none.alias("title"), none.cast("date").alias("start_date"), none.alias("match_key"), none.alias("phash"), F.lit("old").alias("source"), none.alias("source_url"),
        F.lit("queued").alias("outcome"), then.alias("first_seen"), then.alias("last_seen"))
    new = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("fingerprint"), none.alias("title"), none.cast("date").alias("start_date"), none.alias("match_key"), none.alias("phash"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"),
        none.alias("source_url"), F.col("lang").alias("outcome"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return memory.record(ledger, new, STAMP).select("fingerprint", "source", "outcome", day("first_seen"), day("last_seen"))


@query("""WITH k AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || '|' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'customer ' || o_custkey END AS key FROM orders),
g AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') || '|customer ' || l_suppkey AS key FROM lineitem) SELECT id FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = k.key)""")
def composite_key_antijoin(spark, sf_dir):
    rows = order_listings(spark, sf_dir).select("id", hashing.match_key(F.col("start_date"), F.when(F.col("id") % 5 != 0, F.col("location"))).alias("match_key"))
    ledger = _table(spark, sf_dir, "lineitem").select(hashing.match_key(F.to_date("l_shipdate"), F.concat(F.lit("Customer "), F.col("l_suppkey").cast("string"))).alias("match_key"))
    return memory.unseen_key(rows, ledger).select("id")


@query("""WITH f AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_custkey AS c, first_value(CAST(o_orderdate AS DATE)) OVER w AS fd, first_value(o_orderkey) OVER w AS fk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
odd AS (SELECT * FROM f WHERE d <> fd) SELECT id AS ordinal, CAST(fd AS VARCHAR) AS other_date FROM odd UNION ALL SELECT fk, CAST(min(d) AS VARCHAR) FROM odd GROUP BY fk""")
def image_twins(spark, sf_dir):
    rows = order_listings(spark, sf_dir).select(F.col("id").alias("ordinal"), "start_date", F.col("location").alias("flyer_phash"), F.lit(1).alias("confidence"))
    return linkage.image_twins(rows).select("ordinal", _iso("other_date"))


@query("""SELECT CAST(page_id AS VARCHAR) AS fingerprint, page_id || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS object FROM pages WHERE regexp_matches(url, '^(?i)https?://') AND NOT contains(url, 'example.org') AND page_id % 3 > 0""")
def object_names(spark, sf_dir):
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, ".exe").when(k % 2 == 0, ".JPG?x=1").otherwise(".png")
    rows = _table(spark, sf_dir, "pages").select(k.cast("string").alias("fingerprint"), F.concat("url", F.lit("/f"), kind).alias("flyer_url"))
    return publish.object_names(rows, "example.org").select("fingerprint", "object")


@query(_L + "SELECT id, title, CAST(start_date AS VARCHAR) AS start_date FROM l WHERE id % 6 > 0")
def insert_rows(spark, sf_dir):
    """Only complete rows are published."""
    rows = order_listings(spark, sf_dir).withColumns({"fingerprint": F.col("id"), "location": F.when(F.col("id") % 6 > 0, F.col("location")), "flyer_url": F.lit(None).cast("string")})
    return publish.insert_rows(rows).select(F.col("fingerprint").alias("id"), "title", _iso("start_date"))


@query("SELECT event_id AS key FROM events WHERE 1705000000000 - (epoch_us(ts) // 1000) < 43200000")
def fresh_cache(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("fetched_ms"))
    return state.fresh_cache(rows, 1705000000000).select("key")


@query("""SELECT count(*) FILTER (a = 'added') AS added, count(*) FILTER (a = 'skipped') AS skipped, count(*) FILTER (a = 'vanished') AS vanished, count(*) FILTER (a = 'gone') AS gone FROM (
SELECT CASE WHEN d.doc_id IS NULL THEN 'vanished' WHEN l.doc_id IS NOT NULL AND l.quality = d.n_chars % 2 THEN 'skipped' ELSE 'added' END AS a FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id)""")
def inventory_summary(spark, sf_dir):
    stamp = F.lit(STAMP)
    manifest = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("long").alias("size"), F.lit(True).alias("in_bucket"), stamp.alias("first_backed_up"), stamp.alias("last_seen"), F.lit(None).cast("timestamp").alias("gone_since"))
    return reconcile.summary(reconcile.reconcile(manifest, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), (F.col("n_chars") % 2).alias("size")), STAMP)).select("added", "skipped", "vanished", "gone")


@query("""SELECT count(*) AS collected, count(*) FILTER (d = 'past') AS past, count(*) FILTER (d = 'queued') AS queued, count(*) FILTER (d = 'seen') AS seen, count(*) FILTER (d = 'queued' AND doc_id % 2 = 0) AS needs_check
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'past' WHEN 1 THEN 'queued' ELSE 'seen' END AS d FROM documents)""")
def run_statistics(spark, sf_dir):
    k = F.col("doc_id")
    rows = _table(spark, sf_dir, "documents").select("source", F.when(k % 3 == 0, "past").when(k % 3 == 1, "queued").otherwise("seen").alias("disposition"), F.array_repeat(F.lit("w"), F.when(k % 2 == 0, 1).otherwise(0)).alias("warnings"))
    return enrich.run_statistics(rows).select("collected", "past", "queued", "seen", "needs_check")


@query(_L + """SELECT id, tribe, ((row_number() OVER (PARTITION BY tribe ORDER BY start_date DESC NULLS LAST, id DESC) - 1) // 50 + 1)::INT AS page FROM l WHERE report_count < 3 AND (start_date IS NULL OR start_date < DATE '1999-01-01')""")
def past_pages(spark, sf_dir):
    """The past listing the other way round: the page of each row within its group."""
    rows = listing.past(listing.visible(order_listings(spark, sf_dir)), AS_OF)
    return listing.page_numbers(rows, ["tribe"], listing.order("past"), 50).select("id", "tribe", "page")


@query("""SELECT o_orderkey AS id, ((row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) - 1) // 3 + 1)::INT AS page FROM orders""")
def admin_pages(spark, sf_dir):
    """The administrator's order, the newest first, per customer."""
    rows = order_listings(spark, sf_dir).withColumn("created_at", F.col("start_date").cast("timestamp"))
    return listing.page_numbers(rows, ["location"], listing.order("admin")).select("id", "page")


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE), l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def first_shipped(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("shipped"))
    return listing.first_of(rows, ["id"], ["shipped", "line"]).select("id", "line", _iso("shipped"))


@query("""SELECT o_orderkey AS id, coalesce(CASE d.last.f WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' END, 'pending') AS state FROM orders LEFT JOIN (
SELECT l_orderkey, max({'n': l_linenumber, 'f': l_returnflag}) AS last FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) d ON l_orderkey = o_orderkey""")
def review_states(spark, sf_dir):
    """Lines as decisions: the last that is known counts."""
    flag = F.col("l_returnflag")
    decisions = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(flag == "A", "approved").when(flag == "R", "rejected").otherwise("later").alias("state"), F.col("l_linenumber").alias("decided_at"))
    return listing.review_state(order_listings(spark, sf_dir).select("id"), decisions)


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey ELSE 'Order: ' || o_orderpriority END AS title, CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start_date,
CASE WHEN o_orderkey % 3 > 0 THEN 'Customer ' || o_custkey END AS location, o_orderkey % 3 = 0 AS title_provisional, 'local:///in/order_' || o_orderkey || '.JPG' AS flyer_url,
CASE WHEN o_orderkey % 3 > 0 THEN 'title,start_date,location' ELSE '' END AS manual FROM orders""")
def inbox_images(spark, sf_dir):
    """Orders as images with notes, two of three; a key that stands twice goes by its last line."""
    k = F.col("o_orderkey").cast("string")
    orders = _table(spark, sf_dir, "orders")
    files = orders.select(F.explode(F.array(F.concat(F.lit("/in/order_"), k, F.lit(".JPG")), F.concat(F.lit("/in/order_"), k, F.lit(".pdf")))).alias("path"))
    text = F.concat(F.lit("title: none\nTitle: Order: "), F.col("o_orderpriority"), F.lit("\nno field\nlocation:\nDATE: "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("\nlocation: Customer "), F.col("o_custkey").cast("string"))
    notes = orders.where("o_orderkey % 3 > 0").select(F.concat(F.lit("/in/order_"), k, F.lit(".txt")).alias("path"), text.alias("text"))
    rows = inbox.from_images(files, notes, AS_OF)
    return rows.select("title", _iso("start_date"), "location", "title_provisional", "flyer_url", F.array_join("manual_fields", ",").alias("manual"))


@query("""SELECT 'https://x.example/' || o_orderkey || CASE WHEN o_orderkey % 3 = 1 THEN '.png?v=1' ELSE '' END AS source_url,
CASE WHEN o_orderkey % 2 = 0 THEN 'note ' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'Flyer from pasted link' ELSE 'https://x.example/' || o_orderkey END AS title,
CASE WHEN o_orderkey % 3 = 1 THEN 40 ELSE 15 END AS confidence, CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 1 END AS n_warnings FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT 'https://x.example/' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'note ' || o_custkey ELSE 'Tournament of ' || o_orderkey END, 35, 0 FROM orders WHERE o_orderkey % 3 = 0""")
def inbox_links(spark, sf_dir):
    """Orders as pasted links: images, pages that were fetched and pages that weren't, half of them with a note."""
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://x.example/"), k.cast("string"), F.when(k % 3 == 1, ".png?v=1").otherwise(""))
    orders = _table(spark, sf_dir, "orders")
    lines = orders.select(F.explode(F.array(F.concat(F.lit(" "), url, F.when(k % 2 == 0, F.concat(F.lit(" note "), F.col("o_custkey").cast("string"))).otherwise("")), F.concat(F.lit("# "), url), F.lit(""))).alias("line"))
    pages = orders.where("o_orderkey % 3 = 0").select(url.alias("url"), F.concat(F.lit("<h1>Tournament of "), k.cast("string"), F.lit("</h1><p>welcome</p>")).alias("html"))
    with vocab.using(FEED_WORDS):
        return inbox.from_links(lines, pages, AS_OF).select("source_url", "title", F.col("confidence").cast("int").alias("confidence"), F.size("warnings").alias("n_warnings"))


def _event_page(title, day):
    return F.concat(F.lit('<script type="application/ld+json">{"@type":"Event","name":"'), title, F.lit('","startDate":"'), F.date_format(day, "yyyy-MM-dd"), F.lit('T10:00"}</script>'))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, 'Tournament ' || o_custkey AS t FROM orders)
SELECT 'https://s' || k || '.example/' AS source_url, t AS title, d AS start_date, 'Town ' || k AS location FROM o WHERE k % 2 = 0
UNION ALL SELECT 'https://s' || k || '.example/events', t || ' deep', d, 'Town ' || k FROM o WHERE k % 3 > 0""")
def site_scan(spark, sf_dir):
    """Orders as sites, half with an event on the front page, all with a link to a page of events that was fetched for two of three."""
    k = F.col("o_orderkey")
    title, root = F.concat(F.lit("Tournament "), F.col("o_custkey").cast("string")), F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/"))
    none = F.lit(None).cast("string")
    orders = _table(spark, sf_dir, "orders")
    front = F.concat(F.lit('<a href="/events">Calendar of events</a>'), F.when(k % 2 == 0, _event_page(title, F.col("o_orderdate"))).otherwise(""))
    sites = orders.select(root.alias("url"), front.alias("html"), F.concat(F.lit("Town "), k.cast("string")).alias("site_location"), none.alias("site_tribe"), none.alias("hint"), F.lit(True).alias("follow"))
    fetched = orders.where("o_orderkey % 3 > 0").select(F.concat(root, F.lit("events")).alias("url"), _event_page(F.concat(title, F.lit(" deep")), F.col("o_orderdate")).alias("html"))
    with vocab.using(FEED_WORDS):
        rows = web.scan_sites(sites, fetched, AS_OF).where("confidence = 85")  # the structured ones
    return rows.select("source_url", "title", _iso("start_date"), "location")


@query("""SELECT 'https://s' || o_orderkey || '.example/' AS source_url, 'Tournament ' || o_custkey AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, CASE WHEN o_orderkey % 2 = 0 THEN 80 ELSE 50 END AS confidence FROM orders""")
def search_found(spark, sf_dir):
    """Orders as pages that a search found: half with a structured event, half as text."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    title = F.concat(F.lit("Tournament "), F.col("o_custkey").cast("string"))
    text = F.concat(F.lit("<nav>menu</nav><h1>"), title, F.lit("</h1><p>tournament on "), F.date_format(day, "MMMM d, yyyy"), F.lit("</p>"))
    pages = _table(spark, sf_dir, "orders").select(F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/")).alias("url"), F.when(k % 2 == 0, _event_page(title, day)).otherwise(text).alias("html"), F.lit("s").alias("snippet"))
    with vocab.using(FEED_WORDS):
        return web.from_search_pages(pages, AS_OF).select("source_url", "title", _iso("start_date"), F.col("confidence").cast("int").alias("confidence"))


@query("""WITH h AS (SELECT 'https://' || lang || '.example/' || (doc_id // 2) AS url, doc_id, lang FROM documents), f AS (SELECT url, min(doc_id) AS pos FROM h WHERE lang <> 'de' GROUP BY 1)
SELECT (row_number() OVER (ORDER BY pos, url))::INT AS rank, url FROM f ORDER BY pos, url LIMIT 40""")
def search_to_read(spark, sf_dir):
    """Documents as hits of one query: distinct addresses, one host left out, and the 40 that a run reads."""
    hits = _table(spark, sf_dir, "documents").select(F.lit("events 2026").alias("query"), F.col("doc_id").alias("at"), F.concat(F.lit("https://"), "lang", F.lit(".example/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.lit("tournament").alias("snippet"))
    with vocab.using(FEED_WORDS):
        return feeds.search_pages(["events {year}"], [2026], hits, spark.createDataFrame([("de.example",)], "host string")).select("rank", "url")


_BITS = "SELECT vec_id, list_reduce(list_transform(embedding[1:24], lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS UBIGINT) << (24 - i) ELSE CAST(0 AS UBIGINT) END), lambda a, b: a + b) AS h FROM embeddings"


@query(f"WITH s AS ({_BITS}) SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS bits FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 1")
def near_hash_six_digits(spark, sf_dir):
    """The signs of 24 places of a vector as a hash of six digits; pairs at most a bit apart."""
    digit = lambda k: F.conv(F.array_join(F.transform(F.slice("embedding", 4 * k + 1, 4), lambda x: F.when(x > 0, "1").otherwise("0")), ""), 2, 16)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.concat(*[digit(k) for k in range(6)]).alias("h"))
    pairs = memory.near_hash_any(rows.withColumnRenamed("vec_id", "a"), rows.withColumnRenamed("vec_id", "b"), "a", "b", "h", max_bits=1)
    return pairs.where("a < b").select("a", "b", F.col("bits").cast("long").alias("bits"))


@query("SELECT CAST(doc_id AS VARCHAR) AS fingerprint, source AS title FROM documents")
def review_pages(spark, sf_dir):
    """Documents as a queue in pages, and the rows read back out of the pages' data."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("fingerprint"), F.concat(F.col("source"), F.lit("</script>")).alias("title"))
    pages = publish.review_pages(rows, [F.col("fingerprint")])
    data = F.regexp_extract("html", '(?s)id="data">(.*?)</script>', 1)
    events = pages.select(F.explode(F.from_json(data, "events array<struct<fingerprint:string,title:string>>").events).alias("e"))
    return events.select("e.fingerprint", F.replace("e.title", F.lit("</script>"), F.lit("")).alias("title"))


@query("""SELECT count(*) FILTER (o_orderkey % 7 > 0) AS added, count(*) FILTER (o_orderkey % 7 = 0) AS failed, count(*) FILTER (o_orderkey % 2 = 0) AS mirrored FROM orders""")
def publish_counts(spark, sf_dir):
    """Orders published through a site that refuses every seventh; images of every other one are mirrored."""

    def send(row, approved):
        if int(row["fingerprint"]) % 7 == 0:
            raise ValueError("refused")

    def mirror(row):
        return "https://own.example/x" if int(row["fingerprint"]) % 2 == 0 else None

    rows = order_listings(spark, sf_dir).withColumns({"fingerprint": F.col("id").cast("string"), "flyer_url": F.lit("https://x.example/a.png")})
    status = publish.publish(rows, send, mirror=mirror)
    return publish.publish_summary(status)


@query("""SELECT count(*) FILTER (l.doc_id IS NULL AND d.doc_id % 5 > 0) AS added, count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS skipped, count(*) FILTER (d.doc_id IS NULL) AS vanished, count(*) FILTER (l.doc_id IS NULL AND d.doc_id % 5 = 0) AS failed
FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def backup_counts(spark, sf_dir):
    """Documents as a bucket, labels as what is held of it; every fifth object can't be copied."""
    stamp = F.lit(STAMP)
    manifest = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name")).distinct().select("name", F.lit(1).cast("long").alias("size"), F.lit(True).alias("in_bucket"), stamp.alias("first_backed_up"), stamp.alias("last_seen"), F.lit(None).cast("timestamp").alias("gone_since"))

    def copy(name):
        if int(name) % 5 == 0:
            raise OSError("no copy")

    found = reconcile.reconcile(manifest, _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lit(1).cast("long").alias("size")), STAMP)
    return reconcile.summary(reconcile.settle(found, reconcile.back_up(found, copy))).select("added", "skipped", "vanished", "failed")


_HASHED = """WITH c AS (SELECT c_custkey AS id, md5(CAST(c_custkey // 3 AS VARCHAR)) AS base FROM customer),
h AS (SELECT id, xor(xor(CAST('0x' || base[1:16] AS UBIGINT), CAST(1 AS UBIGINT) << (id % 64)), CAST(1 AS UBIGINT) << (id * 7 % 64)) AS h FROM c)
"""


def _image_hashes(spark, sf_dir):
    """Customers in threes with a hash of 16 digits in common, but for one or two bits of each."""
    first = F.conv(F.substr(F.md5(F.floor(F.col("c_custkey") / 3).cast("string").cast("binary")), F.lit(1), F.lit(16)), 16, -10).cast("long")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (k % 64).cast("int"))
    mixed = first.bitwiseXOR(bit(F.col("c_custkey"))).bitwiseXOR(bit(F.col("c_custkey") * 7))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.lpad(F.hex(mixed), 16, "0")).alias("h"))


def _long_hashes(spark, sf_dir):
    """The same with 48 more digits that a three has in common: only those of a three are near, however many there are."""
    return _image_hashes(spark, sf_dir).withColumn("h", F.concat("h", F.substr(F.sha2(F.floor(F.col("id") / 3).cast("string").cast("binary"), 256), F.lit(17), F.lit(48))))


@query(_HASHED + "SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS bits FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 12")
def near_images_16(spark, sf_dir):
    """Multi-index hashing on hashes of 16 digits, with pairs to find."""
    rows = _image_hashes(spark, sf_dir)
    pairs = memory.near_hash_short(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), "a", "b", "h")
    return pairs.where("a < b").select("a", "b", F.col("bits").cast("long").alias("bits"))


@query(_HASHED + """, w AS (SELECT h.id, h.h, sha256(CAST(h.id // 3 AS VARCHAR)) AS s FROM h)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS bits FROM w a JOIN w b ON a.id < b.id AND a.s = b.s WHERE bit_count(xor(a.h, b.h)) <= 12""")
def near_images_64(spark, sf_dir):
    """The same on hashes of 64 digits, of which the first 16 are as above."""
    rows = _long_hashes(spark, sf_dir)
    pairs = memory.near_hash_pairs(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), "a", "b", "h")
    return pairs.where("a < b").select("a", "b", F.col("bits").cast("long").alias("bits"))


@query("""WITH known AS (SELECT c_custkey // 3 AS g, min(c_custkey) AS twin FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN twin IS NULL THEN 'none' WHEN twin % 2 <> c_custkey % 2 THEN 'warn' ELSE 'drop' END AS verdict,
CASE WHEN twin % 2 <> c_custkey % 2 THEN 1 ELSE 0 END AS n_warnings FROM customer LEFT JOIN known ON g = c_custkey // 3""")
def image_verdicts(spark, sf_dir):
    """Customers beside a ledger of every fifth: a near image of another date makes a warning, one of the same date drops the row. Of hashes of 16 digits some are near by chance, which SQL doesn't say; these have 64."""
    day = F.date_add(F.lit(AS_OF), (F.col("id") % 2).cast("int"))
    rows = _long_hashes(spark, sf_dir).select(F.format_string("%08d", "id").alias("fingerprint"), F.col("h").alias("flyer_phash"), day.alias("start_date"), F.array().cast("array<string>").alias("warnings"), "id")
    ledger = rows.where("id % 5 = 0").select("fingerprint", F.col("flyer_phash").alias("phash"), "start_date")
    out = memory.judge_image_twins(rows, ledger)
    return out.select("id", F.col("image_verdict").alias("verdict"), F.size("warnings").alias("n_warnings"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS site, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'json' ELSE 'ics' END AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date FROM orders WHERE o_orderkey % 4 <> 3""")
def feed_ladder(spark, sf_dir):
    """Orders as sites with both feeds, one, one that keeps nothing, and none: an iCal feed counts only where no event feed has a row that is kept; of two addresses the first with events counts."""
    k, orders = F.col("o_orderkey"), _table(spark, sf_dir, "orders")
    json = lambda title: F.concat(F.lit('{"events":[{"title":"'), F.lit(title), F.lit('","start_date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}]}'))
    ics = lambda title: F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:"), F.lit(title), F.lit("\nDTSTART:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("\nEND:VEVENT"))
    many = [(F.when(k % 4 == 1, '{"events":[]}'), "json", 0), (F.when(k % 4 <= 1, json("Tournament json")).when(k % 4 == 2, json("Bingo")), "json", 1), (F.when(k % 4 == 0, json("Tournament late")), "json", 2),
            (F.when(k % 4 == 2, "no calendar"), "ics", 0), (F.when(k % 4 != 3, ics("Tournament ics")), "ics", 1)]
    tried = F.explode(F.array(*[F.struct(body.alias("body"), F.lit(kind).alias("kind"), F.lit(step).alias("step")) for body, kind, step in many]))
    none = F.lit(None).cast("string")
    bodies = orders.select(k.cast("string").alias("site"), "o_orderdate", tried.alias("b")).select("site", "b.*", F.lit("http://e.example/").alias("url"), none.alias("site_location"), none.alias("site_tribe"), none.alias("hint"))
    with vocab.using(FEED_WORDS):
        rows = feeds.from_ladder(bodies)
    return rows.select("site", F.substring_index("title", " ", -1).alias("title"), _iso("start_date"))
