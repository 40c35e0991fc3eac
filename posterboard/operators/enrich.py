"""Filling a record from text and from a flyer reader, its confidence, and what becomes of it."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import find_dates

MIN_TOPIC_TENTHS = 5
FEED = "calendars"


def tidy(rows: DataFrame) -> DataFrame:
    """Cleans and cuts the text fields, softens shouted titles, and drops an end before the start with a warning."""
    limits = {"title": 200, "location": 200, "tribe": 120, "details": 2000, "raw_text": 4000}
    rows = rows.withColumns({c: T.clean(F.col(c), n) for c, n in limits.items()})
    odd = F.coalesce(F.col("end_date") < F.col("start_date"), F.lit(False))
    return rows.withColumns({
        "title": T.soften_shouting(F.coalesce("title", F.lit(""))),
        "warnings": F.when(odd, F.array_append("warnings", F.lit("end date was before the start date and was dropped"))).otherwise(F.col("warnings")),
        "end_date": F.when(~odd, F.col("end_date")),
    })


def append_new_contacts(details: Column, text: Column) -> Column:
    """details with the contacts of text that it doesn't hold yet."""
    old = F.coalesce(details, F.lit(""))
    new = F.array_join(F.filter(T.contact_bits(text), lambda b: ~F.contains(old, b)), ", ")
    return F.when(new == "", details).when(old == "", new).otherwise(F.concat(old, F.lit(" · "), new))


def fill_from_text(rows: DataFrame, as_of: dt.date, extraction: str, column: str = "raw_text") -> DataFrame:
    """Fills only what is blank. Dates are scanned only for rows without one: the rows are parted, so that the scanner isn't run on the others."""
    text = F.col(column)
    dated = rows.where("start_date IS NOT NULL")
    undated = rows.where("start_date IS NULL").withColumn("_d", find_dates(text, as_of))
    found = F.col("_d.start").isNotNull()
    undated = undated.withColumns({
        "start_date": F.col("_d.start"), "end_date": F.coalesce(F.col("_d.end"), "end_date"),
        "extraction": F.when(found, extraction).otherwise(F.col("extraction")),
        "warnings": F.when(found, F.concat("warnings", "_d.warnings")).otherwise(F.col("warnings")),
    }).drop("_d")
    rows = dated.unionByName(undated)
    better, open_title = T.guess_title(text), (F.coalesce("title", F.lit("")) == "") | F.coalesce("title_provisional", F.lit(False))
    take = open_title & better.isNotNull()
    return rows.withColumns({
        "location": F.coalesce(T.blank_to_null(F.col("location")), T.find_location(text)),
        "tribe": F.coalesce(T.blank_to_null(F.col("tribe")), T.find_tribe(text)),
        "title": F.when(take, better).otherwise(F.col("title")),
        "title_provisional": F.coalesce("title_provisional", F.lit(False)) & ~take,
        "details": append_new_contacts(F.col("details"), text),
    })


def fill_from_reader(rows: DataFrame, reader: str = "reader") -> DataFrame:
    """Applies a flyer reader's struct (title, start_date, end_date, location, tribe, details as strings, is_topic, year_printed booleans).

    A person's fields stand, then a feed's, then the reader's for title, dates and location; elsewhere the reader fills blanks. A date that the reader
    changes makes a warning; a date that is no ISO date is refused; a reader that says the topic is wrong changes nothing but the warnings.
    """
    r = lambda f: F.col(f"{reader}.{f}")
    off = F.coalesce(~r("is_topic"), F.lit(False))
    feed = F.coalesce(F.col("source") == FEED, F.lit(False))
    notes, new, changed = [F.when(off, F.lit("flyer reader says this is another kind of event"))], {}, F.lit(False)
    for f in ("title", "start_date", "end_date", "location", "tribe", "details"):
        is_date, may_replace = f.endswith("_date"), f in ("title", "start_date", "end_date", "location")
        value = F.try_to_date(F.when(r(f).rlike(r"^\d{4}-\d{2}-\d{2}$"), r(f)), "yyyy-MM-dd") if is_date else F.nullif(r(f), F.lit(""))
        current = F.col(f) if is_date else F.nullif(F.col(f), F.lit(""))
        manual = F.array_contains(F.coalesce("manual_fields", F.array().cast("array<string>")), f)
        replace = current.isNotNull() & (value != current) & ~feed & F.lit(may_replace)
        takes = F.coalesce(~off & value.isNotNull() & ~manual & (current.isNull() | replace), F.lit(False))
        if is_date:
            notes.append(F.when(takes & current.isNotNull(), F.format_string(f"{f.replace('_', ' ')}: text says %s, flyer reader says %s; the reader's is used", current.cast("string"), value.cast("string"))))
        if f == "title":
            new["title_provisional"] = F.coalesce("title_provisional", F.lit(False)) & ~takes
        new[f] = F.when(takes, value).otherwise(F.col(f))
        changed = changed | takes
    notes.append(F.when(~off & ~r("year_printed"), F.lit("year was not printed on the flyer; it was inferred")))
    new["extraction"] = F.when(changed, "llm").otherwise(F.col("extraction"))
    new["warnings"] = F.concat("warnings", F.array_compact(F.array(*notes)))
    return rows.withColumns(new)


def all_text() -> Column:
    return F.concat_ws(" ", "title", "details", "raw_text")


def confidence(topic_tenths: Column) -> Column:
    """Hundredths, 0 to 100, so that sums are exact."""
    has = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    points = 35 * has("start_date") + 20 * has("location") + 10 * has("title") + 10 * has("flyer_url") + 5 * has("tribe") + 2 * topic_tenths
    points += F.when(F.col("extraction") == "structured", 5).when(F.col("extraction") == "ocr", -5).otherwise(0) - 7 * F.size("warnings")
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def publishable() -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("title", "start_date", "location")])


def disposition(as_of: dt.date, topic_tenths: Column | None = None, least: int = MIN_TOPIC_TENTHS) -> Column:
    """What becomes of a row; the first that fits."""
    topic = T.topic_tenths(all_text()) if topic_tenths is None else topic_tenths
    return (
        F.when(topic < least, "off_topic").when(~publishable(), "incomplete")
        .when(F.coalesce("end_date", "start_date") < F.lit(as_of), "past").otherwise("keep")
    )


def run_statistics(rows: DataFrame) -> DataFrame:
    """rows: disposition, source, warnings. One row of counts, which add up: collected is the sum of the dispositions."""
    kinds = ("off_topic", "incomplete", "past", "merged", "seen", "live", "flagged", "queued")
    per_source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("disposition") == k).alias(k) for k in kinds],
                                            F.count_if((F.col("disposition") == "queued") & (F.size("warnings") > 0)).alias("needs_check"))
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("collected"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (*kinds, "needs_check")],
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")), "n")))).alias("per_source"),
    )


def queue_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("start_date").asc_nulls_last(), F.desc("confidence"), "fingerprint")


def within_budget(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows with an image, as many as a run may fetch, over all sources. Each task hands on its own first ones, so no task sorts all rows."""
    return rows.where("flyer_url != ''").orderBy(*order).limit(most)
