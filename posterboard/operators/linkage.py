"""Record linkage: which announcements are the same gathering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .collapse import collapse  # noqa: F401  linkage inside a batch
from .live_match import best_live_match  # noqa: F401  linkage to the live table

def route(rows: DataFrame, matches: DataFrame, live: DataFrame) -> DataFrame:
    """Adds disposition and outcome: duplicates are dropped, as live or as flagged by the community; possible ones are queued with a warning."""
    titles = live.select("id", F.col("title").alias("live_title"), F.col("start_date").alias("live_date"))
    rows = rows.join(matches.join(titles, "id", "left"), "fingerprint", "left")
    flagged, duplicate, possible = F.coalesce("flagged", F.lit(False)), F.col("verdict") == "duplicate", F.col("verdict") == "possible"
    shown = F.format_string("'%s' on %s", "live_title", F.col("live_date").cast("string"))
    notes = F.array_compact(F.array(
        F.when(possible & flagged, F.concat(F.lit("resembles an event that the community flagged: "), shown)),
        F.when(possible, F.concat(F.lit("close to an event on the site: "), shown, F.format_string(" (%d%% match)", F.floor(F.col("score") * 100).cast("int")))),
    ))
    return rows.withColumns({
        "warnings": F.concat("warnings", notes),
        "disposition": F.when(duplicate & flagged, "flagged").when(duplicate, "live").otherwise("queued"),
        "outcome": F.when(duplicate & flagged, "community-flagged").when(duplicate, "already-on-site").otherwise("queued"),
    }).drop("live_title", "live_date", "verdict", "id", "score", "flagged")


def image_twins(kept: DataFrame) -> DataFrame:
    """ordinal, other_date: kept rows and the first other kept row with their image on another date; of rows in different islands too."""
    w = Window.partitionBy("flyer_phash").orderBy(F.desc("confidence"), "ordinal")
    rows = kept.where("flyer_phash != ''").withColumns({"first_date": F.first("start_date").over(w), "first_ordinal": F.first("ordinal").over(w)})
    odd = rows.where("start_date != first_date")
    back = odd.groupBy(F.col("first_ordinal").alias("ordinal")).agg(F.min("start_date").alias("other_date"))
    return odd.select("ordinal", F.col("first_date").alias("other_date")).unionByName(back)
