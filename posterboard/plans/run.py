"""One run: sources to a review queue, a new ledger and statistics, as one plan. as_of is explicit; no stage asks for today."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from ..operators import enrich, linkage, memory
from ..schemas import RECORD
from ..session import ensure_checkpoints
from ..sources.base import Outcome, Source, read_all


@dataclass
class Result:
    queue: DataFrame
    ledger: DataFrame
    statistics: DataFrame
    rows: DataFrame  # every collected record with its disposition


def records(parsed: DataFrame, source: str) -> DataFrame:
    """A source's rows as records; columns that it lacks are null."""
    have = dict(parsed.dtypes)
    cols = []
    for c, kind in (x.rsplit(" ", 1) for x in RECORD.split(", ")):
        value = F.col(c) if c in have else F.lit(None)
        if c == "source":
            value = F.lit(source)
        elif c == "warnings":
            value = F.coalesce(value.cast(kind), F.array().cast("array<string>"))
        cols.append(value.cast(kind).alias(c))
    return parsed.select(*cols).where("coalesce(title, '') != '' OR flyer_url IS NOT NULL")


def collect(sources: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """All sources' records, with an ordinal by source order and, within a source, by arrival; sources that aren't asked for aren't planned at all.

    The ordinal is only fixed once it is written, as run does at once.
    """
    chosen = [records(df, name) for name, df in sources.items() if only is None or name in only]
    rows = reduce(lambda a, b: a.unionByName(b), chosen)
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def run_sources(spark: SparkSession, sources: Iterable[Source], ledger: DataFrame, live: DataFrame, as_of: dt.date, stamp: dt.datetime, only: list[str] | None = None) -> tuple[Result | None, list[Outcome]]:
    """As run, of sources that may fail: those that could be read, and what became of each. No result where none could."""
    read, outcomes = read_all(spark, sources, only, shape=records)
    return (run(read, ledger, live, as_of, stamp) if read else None), outcomes


def run(sources: dict[str, DataFrame], ledger: DataFrame, live: DataFrame, as_of: dt.date, stamp: dt.datetime, only: list[str] | None = None) -> Result:
    """live: the LISTING columns. Order: enrich, disposition, collapse, memory, live, queue; cheap tests come before dear ones."""
    ensure_checkpoints(ledger.sparkSession)
    rows = enrich.tidy(enrich.fill_from_text(collect(sources, only), as_of, "ocr"))
    topic = T.topic_tenths(enrich.all_text())
    # each of the tables that several branches read is made once, in the folder that the cluster's checkpoints share
    rows = rows.withColumn("confidence", enrich.confidence(topic)).withColumn("disposition", enrich.disposition(as_of, topic)).checkpoint()
    lost = rows.where("disposition != 'keep'")
    merged = linkage.collapse(rows.where("disposition = 'keep'").drop("disposition")).checkpoint()
    lost = lost.unionByName(merged.where("merged_into IS NOT NULL").drop("merged_into").withColumn("disposition", F.lit("merged")))
    kept = merged.where("merged_into IS NULL").drop("merged_into")
    kept = kept.withColumns({
        "fingerprint": hashing.fingerprint(F.col("source_url"), F.col("title"), F.col("start_date"), F.col("location")),
        "match_key": hashing.match_key(F.col("start_date"), F.col("location")),
    })
    # of rows with one fingerprint the first stays; the others are merged into it
    first = kept.groupBy("fingerprint").agg(F.min("ordinal").alias("_first"))
    kept = kept.join(first, "fingerprint").withColumn("_again", F.col("ordinal") != F.col("_first")).drop("_first")
    again = kept.where("_again").drop("_again").withColumn("disposition", F.lit("merged"))
    kept = kept.where("NOT _again").drop("_again")
    fresh = memory.judge_image_twins(memory.unseen(kept, ledger), ledger).where("image_verdict != 'drop'").drop("image_verdict", "twin_date")
    fresh = memory.unseen_key(fresh, ledger).checkpoint()
    seen = kept.join(fresh.select("fingerprint"), "fingerprint", "left_anti").withColumn("disposition", F.lit("seen"))
    site = live.select("id", "title", "start_date", "location", F.lit(None).cast("string").alias("flyer_phash"), (F.coalesce("report_count", F.lit(0)) >= 3).alias("flagged"))
    routed = linkage.route(fresh, linkage.best_live_match(fresh, site), site).checkpoint()
    columns = [c for c in lost.columns]
    every = lost.select(*columns).unionByName(again.select(*columns)).unionByName(seen.select(*columns)).unionByName(routed.select(*columns))
    new = routed.select("fingerprint", "title", "start_date", "match_key", F.col("flyer_phash").alias("phash"), "source", "source_url", "outcome")
    return Result(
        queue=enrich.queue_order(routed.where("disposition = 'queued'")),
        ledger=memory.prune(memory.record(ledger, new, stamp), as_of),
        statistics=enrich.run_statistics(every), rows=every,
    )
