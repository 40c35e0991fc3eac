"""Sinks: publishing is keyed and idempotent, and a bad row fails alone."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape_html
from .enrich import publishable

COLUMNS = ("title", "start_date", "end_date", "location", "tribe", "details", "flyer_url")


def insert_rows(rows: DataFrame) -> DataFrame:
    """The seven columns that are published, of complete rows, with the key."""
    return rows.where(publishable()).select("fingerprint", *COLUMNS)


def publish(rows: DataFrame, send: Callable[[dict, bool], None], done: DataFrame | None = None, mirror: Callable[[dict], str | None] | None = None) -> DataFrame:
    """Calls send(row, approved) per row in the tasks; returns fingerprint, status (added or failed), error, mirrored.

    mirror(row) is called first and copies the row's image, whose new address (None: it has none of its own) the row is sent with; where it fails, the row goes with the old one.

    A row is sent as approved, and again without that if the site refuses the column. Keys in done were added by an earlier run and aren't sent again; send has to
    treat a key it has as added, as a lost task is run again.
    """
    todo = insert_rows(rows).dropDuplicates(["fingerprint"])
    if done is not None:
        todo = todo.join(done.select("fingerprint").distinct(), "fingerprint", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                error, mirrored = None, False
                if mirror is not None:
                    try:
                        address = mirror(row)
                        row, mirrored = {**row, "flyer_url": address or row["flyer_url"]}, bool(address)
                    except Exception:  # noqa: BLE001  a row is worth more than its image
                        mirrored = False
                for approved in (True, False):
                    try:
                        send(row, approved)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001  a bad row must not stop the others
                        error = str(e)[:500]
                out.append((row["fingerprint"], "failed" if error else "added", error, mirrored))
            yield pd.DataFrame(out, columns=["fingerprint", "status", "error", "mirrored"])

    return todo.mapInPandas(run, "fingerprint string, status string, error string, mirrored boolean")


def publish_summary(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("mirrored").alias("mirrored"))


def object_names(rows: DataFrame, own_host: str) -> DataFrame:
    """fingerprint, flyer_url, object of images to mirror: known kinds, not local and not the site's own."""
    kind = F.lower(F.regexp_extract("flyer_url", r"(?i)\.(jpe?g|png|gif|webp)(?:\?.*)?$", 1))
    rows = rows.where(F.col("flyer_url").rlike(r"(?i)^https?://") & ~F.contains("flyer_url", F.lit(own_host)))
    return rows.withColumn("kind", kind).where("kind != ''").select("fingerprint", "flyer_url", F.concat_ws(".", "fingerprint", "kind").alias("object"))


def review_cards(rows: DataFrame) -> DataFrame:
    """fingerprint, html: one escaped card per queued row, for a page that is written part by part."""
    cell = lambda c: escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))
    html = F.concat(F.lit('<article id="'), cell("fingerprint"), F.lit('"><h2>'), cell("title"), F.lit("</h2><p>"), cell("start_date"), F.lit(" "), cell("location"), F.lit("</p></article>"))
    return rows.select("fingerprint", html.alias("html"))


def _for_script(data: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(data, F.lit("</"), F.lit("<\\/"))


#: A page that shows what is in its data.
PAGE = (
    '<!doctype html><meta charset="utf-8"><title>Review</title><main></main><script type="application/json" id="data">',
    "</script><script>for (const e of JSON.parse(document.getElementById('data').textContent).events) {"
    "const a = document.createElement('article'); a.id = e.fingerprint;"
    "for (const f of ['title', 'start_date', 'location', 'details']) { const p = document.createElement('p'); p.textContent = e[f] ?? ''; a.append(p); }"
    "document.querySelector('main').append(a); }</script>",
)


def review_pages(rows: DataFrame, order: list[Column], statistics: dict | None = None, per_page: int = 500) -> DataFrame:
    """page, n, html: the queue as self-contained pages of at most per_page rows, in the given total order. statistics stand in each page's data.

    Rows are dealt by ranges of the order and numbered within each, so no task holds more than a range; the last page of a range may be short.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    dealt = dealt.withColumn("_rank", rank).withColumn("_chunk", F.floor((F.col("_rank") - 1) / per_page))
    events = F.array_sort(F.collect_list(F.struct("_rank", F.to_json(F.struct(*rows.columns)).alias("json"))))
    pages = dealt.groupBy("_part", "_chunk").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(events, lambda e: e.json), ",").alias("_events"))
    data = F.concat(F.lit('{"stats":' + json.dumps(statistics or {}) + ',"events":['), "_events", F.lit("]}"))
    name = F.format_string("%05d-%05d", "_part", "_chunk")
    return pages.select(name.alias("page"), "n", F.concat(F.lit(PAGE[0]), _for_script(data), F.lit(PAGE[1])).alias("html"))


def write_pending(queue: DataFrame, statistics: DataFrame, rows: DataFrame, folder: str) -> None:
    """A run's result as JSON: the folders queue, statistics and rows."""
    for name, df in (("queue", queue), ("statistics", statistics), ("rows", rows)):
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def apply_admin(listings: DataFrame, updates: DataFrame, deleted: DataFrame) -> DataFrame:
    """The listings with approvals changed (updates: id, approved) and rows taken out (deleted: id)."""
    last = updates.groupBy("id").agg(F.bool_or("approved").alias("_approved"))
    out = listings.join(deleted.select("id").distinct(), "id", "left_anti").join(last, "id", "left")
    return out.withColumn("approved", F.coalesce("_approved", "approved")).drop("_approved").select(*listings.columns)
