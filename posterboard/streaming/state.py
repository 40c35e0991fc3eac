"""State over time: reports, rate limits, a breaker for hosts, and the memory of a stream. Batch and streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .limiter import MAX_ACCEPTED, WINDOW_MS, rate_limited  # noqa: F401  the batch form

BREAK_AT, MAX_DELAY, MAX_RETRY_AFTER = 3, 30.0, 60.0


def report_counts(reports: DataFrame) -> DataFrame:
    """reports: client, event. One report a client and event counts: event, n. Works on streams, in update mode."""
    return reports.dropDuplicates(["client", "event"]).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def hidden_events(reports: DataFrame, at: int = 3) -> DataFrame:
    return report_counts(reports).where(F.col("n") >= at)


def accept(times: list[int], recent: list[int], most: int = MAX_ACCEPTED, window: int = WINDOW_MS) -> tuple[list[bool], list[int]]:
    """Whether each ascending time is accepted: fewer than most accepted ones lie within the window before it. Returns the decisions and what to remember."""
    out = []
    for t in times:
        recent = [r for r in recent if t - r < window]
        ok = len(recent) < most
        out.append(ok)
        if ok:
            recent.append(t)
    return out, recent


def rate_limited_stream(attempts: DataFrame, most: int = MAX_ACCEPTED, window: int = WINDOW_MS) -> DataFrame:
    """rate_limited for a stream; state per client is the accepted times of the last window, dropped when the client is silent for one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ms", "seq"])
        ok, recent = accept([int(t) for t in pdf["ms"]], list(state.get[0]) if state.exists else [], most, window)
        state.update((recent,))
        state.setTimeoutDuration(window)
        yield pdf[["client", "ms", "seq"]].assign(accepted=ok)

    kind = dict(attempts.dtypes)["client"]
    return attempts.select("client", "ms", "seq").groupBy("client").applyInPandasWithState(
        run, f"client {kind}, ms long, seq long, accepted boolean", "recent array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def host_breaker(answers: DataFrame, delay: float = 2.0) -> DataFrame:
    """answers: host, seq, status, retry_after. Adds delay_s and dropped, as they stand after each answer.

    A 429 doubles the host's delay up to MAX_DELAY (or takes Retry-After, up to MAX_RETRY_AFTER, if that is longer); BREAK_AT of them in a row drop the host. Any other answer ends the
    row and leaves the delay. In closed form: doublings so far, and the length of the current row.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("host").orderBy("seq")
    hit = F.when(F.col("status") == 429, 1).otherwise(0)
    rows = answers.withColumns({"_hits": F.sum(hit).over(order), "_runs": F.sum(1 - hit).over(order)})
    run = Window.partitionBy("host", "_runs").orderBy("seq")
    rows = rows.withColumn("_row", F.sum(hit).over(run))
    rows = rows.withColumn("dropped", F.max(F.col("_row") >= BREAK_AT).over(order))
    doubled = F.least(F.lit(MAX_DELAY), F.lit(delay) * F.pow(F.lit(2.0), F.least("_hits", F.lit(10))))
    wait = F.least(F.coalesce("retry_after", F.lit(0.0)), F.lit(MAX_RETRY_AFTER))
    return rows.withColumn("delay_s", F.when(F.col("status") == 429, F.greatest(doubled, wait)).otherwise(doubled)).drop("_hits", "_runs", "_row")


def fresh_cache(cache: DataFrame, now_ms: int, ttl_ms: int = 12 * 3_600_000) -> DataFrame:
    """Cache rows (key, fetched_ms) younger than the limit."""
    return cache.where(F.lit(now_ms) - F.col("fetched_ms") < ttl_ms)
