"""Feeds to records: event JSON and iCal, as expressions over rows of (url, body)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

WP = (
    "events array<struct<title:string,description:string,start_date:string,utc_start_date:string,end_date:string,utc_end_date:string,url:string,"
    "image:string,venue:struct<venue:string,city:string,state:string>>>"
)
PARSED = ("title", "start_date", "end_date", "location", "tribe", "details", "flyer_url", "source_url", "extraction", "raw_text")


def _gate(rows: DataFrame, hint: Column | None, least: int) -> DataFrame:
    return rows.where(T.topic_tenths(F.concat_ws(" ", "title", "details"), hint) >= least)


def _site(bodies: DataFrame) -> list[str]:
    """The site stays with a record where the bodies have it."""
    return ["site"] if "site" in bodies.columns else []


def from_event_json(bodies: DataFrame, least: int = 5) -> DataFrame:
    """bodies: url, body, site_location, site_tribe, hint. A record per event that is on topic; a body that doesn't parse gives none.

    An image may be a text or an object with a url. The topic gate comes before all other work.
    """
    rows = bodies.withColumn("e", F.explode(F.from_json("body", WP).events))
    e = lambda f: F.col(f"e.{f}")
    rows = rows.withColumns({"title": T.strip_html(e("title")), "details": T.strip_html(e("description"))})
    rows = _gate(rows, F.col("hint"), least)
    venue = F.concat_ws(", ", *[T.blank_to_null(e(f"venue.{f}")) for f in ("venue", "city", "state")])
    image = F.when(F.startswith(e("image"), F.lit("{")), F.get_json_object(e("image"), "$.url")).otherwise(e("image"))
    return rows.select(
        "title", T.iso_prefix_date(F.coalesce(e("start_date"), e("utc_start_date"))).alias("start_date"),
        T.iso_prefix_date(F.coalesce(e("end_date"), e("utc_end_date"))).alias("end_date"),
        F.coalesce(F.nullif(venue, F.lit("")), "site_location").alias("location"),
        F.coalesce(T.find_tribe(F.concat_ws(" ", "title", "details", "hint")), "site_tribe").alias("tribe"),
        "details", image.alias("flyer_url"), F.coalesce(e("url"), "url").alias("source_url"), F.lit("structured").alias("extraction"), F.col("details").alias("raw_text"), *_site(bodies),
    )


def ics_fields(block: Column) -> Column:
    """map of a block's fields: folded lines joined, parameters dropped, names in capitals, the first of a name, escapes taken back."""
    lines = F.split(F.regexp_replace(block, r"\r?\n[ \t]", ""), r"\r?\n|\r")
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(
        F.upper(F.trim(F.substring_index(F.substring_index(x, ":", 1), ";", 1))).alias("k"),
        F.replace(F.replace(F.replace(F.trim(F.substr(x, F.locate(":", x) + 1)), F.lit("\\,"), F.lit(",")), F.lit("\\n"), F.lit(" ")), F.lit("\\;"), F.lit(";")).alias("v"),
    ))
    pairs = F.filter(pairs, lambda p: (p.k != "") & (p.v != ""))
    keys = F.transform(pairs, lambda p: p.k)
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p.k) == i + 1)
    return F.map_from_entries(first)


def from_ics(bodies: DataFrame, least: int = 5, rfc5545_end: bool = False) -> DataFrame:
    """As from_event_json, of iCal bodies. With rfc5545_end the end of an all-day event, which is exclusive, is taken a day back."""
    rows = bodies.withColumn("f", F.explode(F.transform(F.regexp_extract_all("body", F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1)), ics_fields)))
    f = lambda k: F.try_element_at("f", F.lit(k))
    rows = rows.withColumns({"title": F.coalesce(f("SUMMARY"), F.lit("")), "details": f("DESCRIPTION")})
    rows = _gate(rows, F.col("hint"), least).withColumns({"start_date": T.compact_date(f("DTSTART")), "_end": T.compact_date(f("DTEND"))})
    if rfc5545_end:
        rows = rows.withColumn("_end", F.when(f("DTEND").rlike(r"^\d{8}$"), F.date_sub("_end", 1)).otherwise(F.col("_end")))
    return rows.where("start_date IS NOT NULL").select(
        "title", "start_date", F.when(F.col("_end") != F.col("start_date"), F.col("_end")).alias("end_date"), F.coalesce(f("LOCATION"), "site_location").alias("location"),
        F.coalesce(T.find_tribe(F.concat_ws(" ", "title", "details")), "site_tribe").alias("tribe"), "details", F.lit(None).cast("string").alias("flyer_url"),
        F.coalesce(f("URL"), "url").alias("source_url"), F.lit("structured").alias("extraction"), F.col("details").alias("raw_text"), *_site(bodies),
    )


def from_ladder(bodies: DataFrame, least: int = 5, rfc5545_end: bool = False) -> DataFrame:
    """bodies: site, kind (json or ics), step, and what from_event_json needs. The records of each site's first event feed that answers with events and, where none of those is kept, of its first iCal feed with events.

    Steps are the order in which a site's addresses are tried; only the bodies that count are parsed whole. An address that gave nothing has a null body.
    """
    events = F.when(F.col("kind") == "json", F.from_json("body", "events array<struct<title:string>>").events)
    answers = F.when(F.col("kind") == "json", F.size(events) > 0).otherwise(F.contains("body", F.lit("BEGIN:VEVENT")))
    first = bodies.where(answers).groupBy("site", "kind").agg(F.min("step").alias("step"))
    chosen = bodies.join(first, ["site", "kind", "step"], "left_semi")
    own = from_event_json(chosen.where("kind = 'json'"), least)
    rest = chosen.where("kind = 'ics'").join(own.select("site").distinct(), "site", "left_anti")
    return own.unionByName(from_ics(rest, least, rfc5545_end))


def from_posts(bodies: DataFrame, as_of, least: int = 5) -> DataFrame:
    """As from_event_json, of a forum's listing JSON: children with id, title, selftext, permalink and images. A post counts once; it needs a date or an image."""
    from ..functions.dates import find_dates

    kind = "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,permalink:string,created_utc:double,url:string,preview:struct<images:array<struct<source:struct<url:string>>>>,media_metadata:map<string,struct<s:struct<u:string>>>>>>>"
    posts = bodies.select("url", "site_location", "site_tribe", "hint", F.explode(F.from_json("body", kind)["data"]["children"]).alias("c")).withColumn("p", F.col("c.data")).withColumn("_id", F.col("p.id")).dropDuplicates(["_id"])
    posts = posts.withColumns({"title": F.col("p.title"), "details": F.col("p.selftext"), "_text": F.concat_ws("\n", "p.title", "p.selftext")})
    posts = _gate(posts, None, least).withColumn("_d", find_dates(F.col("_text"), as_of))
    first = lambda c: F.try_element_at(c, F.lit(1))
    image = F.coalesce(first(F.col("p.preview.images"))["source"]["url"], F.when(F.col("p.url").rlike(r"(?i)\.(jpe?g|png|gif|webp)$"), F.col("p.url")), first(F.map_values("p.media_metadata"))["s"]["u"])
    posts = posts.withColumn("flyer_url", F.replace(image, F.lit("&amp;"), F.lit("&"))).where("_d.start IS NOT NULL OR flyer_url IS NOT NULL")
    return posts.select(
        "title", F.col("_d.start").alias("start_date"), F.col("_d.end").alias("end_date"), F.coalesce(T.find_location(F.col("_text")), "site_location").alias("location"),
        F.coalesce(T.find_tribe(F.col("_text")), "site_tribe").alias("tribe"), T.snippet(F.col("details")).alias("details"), "flyer_url", F.col("p.permalink").alias("source_url"),
        F.lit("structured").alias("extraction"), F.col("_text").alias("raw_text"),
    )


def with_site(bodies: DataFrame, sites: DataFrame) -> DataFrame:
    """bodies (site, ...) with the fields of its source: site_location, site_tribe, hint, null where the source isn't known. sites has a row per site."""
    return bodies.join(sites.select("site", "site_location", "site_tribe", "hint"), "site", "left")


def forum_requests(forums: list[str], queries: list[str], spark: SparkSession) -> DataFrame:
    """forum, query: what is to be asked, each forum with each query. Both are lists of a configuration."""
    return spark.createDataFrame(list(product(forums, queries)), "forum string, query string")


def search_pages(templates: list[str], years: list[int], hits: DataFrame, skip_hosts: DataFrame, least: int = 5, k: int = 40) -> DataFrame:
    """hits: query, at, url, snippet. The first k urls to be read, with their snippets, by template, year and place among the hits: rank, url, snippet.

    The host isn't skipped and the snippet is on topic. k is the number of pages that one run reads.
    """
    asked = {t.format(year=y): i for i, (t, y) in enumerate(product(templates, years))}
    if not asked:
        return hits.select(F.lit(0).alias("rank"), "url", "snippet").limit(0)
    place = F.try_element_at(F.create_map(*[F.lit(x) for pair in asked.items() for x in pair]), F.col("query"))
    rows = hits.withColumn("_place", place).where("_place IS NOT NULL AND url != ''")
    rows = rows.withColumn("host", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))).join(skip_hosts.select("host").distinct(), "host", "left_anti")
    rows = rows.where(T.topic_tenths(F.col("snippet")) >= least).groupBy("url").agg(F.min(F.struct("_place", "at", "snippet")).alias("f"))
    rows = rows.select("url", "f._place", "f.at", "f.snippet").orderBy("_place", "at", "url").limit(k)
    return rows.select(F.row_number().over(Window.orderBy("_place", "at", "url")).alias("rank"), "url", "snippet")  # k rows at most


def search_urls(templates: DataFrame, years: list[int], hits: DataFrame, skip_hosts: DataFrame, least: int = 5) -> DataFrame:
    """hits: query, url, snippet. Distinct urls of the queries (each template with each year) whose host isn't skipped and whose snippet is on topic."""
    asked = templates.select(F.explode(F.array(*[F.format_string(f"%s {y}", "template") for y in years])).alias("query"))
    rows = hits.join(asked, "query", "left_semi").where(T.topic_tenths(F.col("snippet")) >= least)
    rows = rows.withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1)).join(skip_hosts.select("host").distinct(), "host", "left_anti")
    return rows.select("url").distinct()
