"""State that forgets by event time: a breaker for hosts and the age of cached or remembered rows, as streams with timers.

Both go by the watermark, so a replayed batch or a restart gives the same rows. They need the RocksDB state store (use_timers).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import BREAK_AT, MAX_DELAY, MAX_RETRY_AFTER

FORGET_MS = 24 * 3_600_000


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Breaker(StatefulProcessor):
    def __init__(self, delay: float, forget_ms: int):
        self.delay, self.forget_ms = delay, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("breaker", "hits long, row long, dropped boolean, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits, row, dropped, last = tuple(self.known.get()) if self.known.exists() else (0, 0, False, None)
        pdf, before = pd.concat(list(rows)).sort_values("seq"), last
        delays, drops = [], []
        for status, retry, ms in zip(pdf["status"], pdf["retry_after"], pdf["ms"], strict=True):
            if last is not None and ms - last >= self.forget_ms:
                hits, row, dropped = 0, 0, False
            limited = status == 429
            hits, row = hits + int(limited), row + 1 if limited else 0
            dropped = dropped or row >= BREAK_AT
            wait = min(self.delay * 2.0 ** min(hits, 10), MAX_DELAY)
            if limited and not pd.isna(retry):
                wait = max(wait, min(float(retry), MAX_RETRY_AFTER))
            delays.append(wait)
            drops.append(dropped)
            last = int(ms) if last is None else max(last, int(ms))
        if before is not None:
            self.handle.deleteTimer(before + self.forget_ms)
        self.handle.registerTimer(last + self.forget_ms)
        self.known.update((hits, row, dropped, last))
        yield pd.DataFrame({"host": key[0], "seq": pdf["seq"].to_numpy(), "delay_s": delays, "dropped": drops})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        yield pd.DataFrame({"host": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "delay_s": pd.Series([], dtype=float), "dropped": pd.Series([], dtype=bool)})


def host_breaker_stream(answers: DataFrame, delay: float = 2.0, forget_ms: int = FORGET_MS, late: str = "10 minutes") -> DataFrame:
    """answers: a stream of host, seq, status, retry_after, at (timestamp). Returns host, seq, delay_s, dropped, as state.host_breaker does.

    A host that is silent for forget_ms is forgotten: its next answer starts anew, and a timer takes its state away when the watermark (late behind the latest answer) has passed.
    Answers of a batch go by seq; batches must come in the order of seq. Rows without a host or a time are left out; a null status is any answer but 429.
    """
    rows = answers.select("host", F.col("seq").cast("long").alias("seq"), "status", "retry_after", "at", F.unix_millis("at").alias("ms")).where("host IS NOT NULL AND at IS NOT NULL")
    return rows.withWatermark("at", late).groupBy("host").transformWithStateInPandas(
        _Breaker(delay, forget_ms), "host string, seq long, delay_s double, dropped boolean", "append", "eventTime")


class _Age(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = max(int(pdf["ms"].max()) for pdf in rows)
        before = self.seen.get()[0] if self.seen.exists() else None
        if before is not None and before >= last:
            return
        if before is not None:
            self.handle.deleteTimer(before + self.ttl_ms)
        self.seen.update((last,))
        self.handle.registerTimer(last + self.ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "last_ms": [last], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        self.seen.clear()
        yield pd.DataFrame({"key": [key[0]], "last_ms": [last], "expired": [True]})


def expiry_stream(seen: DataFrame, ttl_ms: int, late: str = "10 minutes") -> DataFrame:
    """seen: a stream of key, at (timestamp): rows of a cache that were fetched, or of a ledger that were seen again. Returns key, last_ms, expired.

    A row says that a key is fresh as of last_ms, or, once the watermark has passed last_ms + ttl_ms without a later row, that it has expired and is forgotten. Nulls are left out.
    """
    rows = seen.where("key IS NOT NULL AND at IS NOT NULL").select("key", "at", F.unix_millis("at").alias("ms"))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Age(ttl_ms), "key string, last_ms long, expired boolean", "append", "eventTime")
