"""Inventories: what a bucket holds against what was kept of it, with tombstones."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(manifest: DataFrame, bucket: DataFrame, stamp: dt.datetime) -> DataFrame:
    """manifest: the MANIFEST columns; bucket: name, size. Returns the new manifest with action: added, skipped, vanished, gone.

    A name that is held with the same size is skipped, one that is new or of another size is added (copied); one that only the manifest has gets gone_since once,
    and its copy stays. A name that comes back is in the bucket again, and keeps its gone_since.
    """
    both = manifest.withColumnRenamed("size", "old_size").join(bucket.select("name", "size", F.lit(True).alias("there")), "name", "full_outer")
    there, known, now = F.coalesce("there", F.lit(False)), F.col("first_backed_up").isNotNull(), F.lit(stamp)
    action = F.when(there & known & F.col("size").eqNullSafe(F.col("old_size")), "skipped").when(there, "added").when(F.col("gone_since").isNull(), "vanished").otherwise("gone")
    return both.select(
        "name", F.when(there, F.col("size")).otherwise(F.col("old_size")).alias("size"), there.alias("in_bucket"),
        F.coalesce("first_backed_up", now).alias("first_backed_up"), F.when(there, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~there, F.coalesce("gone_since", now)).otherwise(F.col("gone_since")).alias("gone_since"), action.alias("action"),
    )


def summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "skipped", "vanished", "gone", "failed")])


def to_copy(reconciled: DataFrame) -> DataFrame:
    """Names whose bytes the append-only backup lacks; nothing is ever deleted from it."""
    return reconciled.where("action = 'added'").select("name", "size")


def back_up(reconciled: DataFrame, copy: Callable[[str], None]) -> DataFrame:
    """Calls copy(name) in the tasks for each name that the backup lacks; returns name, status (added or failed), error. A bad object fails alone; copy may be called twice for a name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                try:
                    copy(name)
                    out.append((name, "added", None))
                except Exception as e:  # noqa: BLE001  the others go on
                    out.append((name, "failed", str(e)[:500]))
            yield pd.DataFrame(out, columns=["name", "status", "error"])

    return to_copy(reconciled).select("name").mapInPandas(run, "name string, status string, error string")


def settle(reconciled: DataFrame, copied: DataFrame) -> DataFrame:
    """The manifest after a backup: what couldn't be copied has the action failed and isn't held, so that the next run tries it again. copied: the rows of back_up, written."""
    failed = copied.where("status = 'failed'").select("name").distinct().withColumn("_failed", F.lit(True))
    out = reconciled.join(failed, "name", "left")
    bad = F.coalesce("_failed", F.lit(False))
    return out.withColumn("action", F.when(bad, "failed").otherwise(F.col("action"))).withColumn("first_backed_up", F.when(~bad, F.col("first_backed_up"))).select(*reconciled.columns)
