"""The rolling rate limit of a busy client in parallel: its attempts are cut into spans, and each span is summed up as a function.

An attempt is accepted if fewer than `most` accepted ones lie within the window before it. By position, the k-th accepted attempt is
x(k) = max(x(k-1) + 1, f(x(k-most))), where f(p) is the first attempt a whole window after attempt p. Both steps are monotone, so x(k) is the largest of
`most` functions, each of one of the first `most` accepted positions of the span: those functions can be tabled, although what is accepted before the span
isn't known yet. What comes in can only shift how many are accepted by `most`, so the last 2 * most positions hold all ways in which the span can end.

1. Each span, a task's work, tables its function over the attempts of its first window. It needs none if no attempt lies in its first window (what came
   before has gone) or none in its last (nothing it accepts matters later).
2. One pass over the spans of a client in order, read batch by batch, looks up what comes into each.
3. Each span, with that known, decides its attempts.

Spans go through tasks in their order, many at a time, so that a client of few attempts costs no more than its rows. A span of which nothing reaches into the next isn't passed on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ACCEPTED, WINDOW_MS = 3, 3_600_000
#: Windows in a span. A table has 2 * most * most entries for each attempt of the first of them.
SPAN_WINDOWS = 16
NEVER = 2**62


def _after(times: np.ndarray, window: int) -> np.ndarray:
    """f: by position, the first attempt a window later; what lies beyond the end stays there."""
    return np.append(np.searchsorted(times, times + window, "left"), len(times))


def _firsts(times: np.ndarray, recent: list[int], most: int, window: int) -> list[int]:
    """The first positions that can be accepted, given the accepted times (ascending) of before."""
    out: list[int] = []
    for t in [-NEVER] * (most - len(recent)) + list(recent):
        at = int(np.searchsorted(times, t + window, "left"))
        out.append(max(at, out[-1] + 1) if out else at)
    return out


def _accepted(after: np.ndarray, firsts: list[int]) -> list[int]:
    """The accepted positions."""
    n, most, x = len(after) - 1, len(firsts), list(firsts)
    while x[-1] < n:
        x.append(max(x[-1] + 1, int(after[x[-most]])))
    return [p for p in x if p < n]


def _function(times: np.ndarray, heads: int, most: int, window: int) -> np.ndarray:
    """Times of the last 2 * most accepted attempts (NEVER: beyond the end), by which of the first accepted positions says so and what that is."""
    n, after = len(times), _after(times, window)
    clock = np.append(times, NEVER)
    y = np.arange(heads + most)
    start = range(most)
    x = [np.minimum(np.stack([y + (i - j) if j <= i else np.zeros_like(y) for j in start]), n) for i in start]
    kept: deque[np.ndarray] = deque(maxlen=2 * most)
    lead: deque[np.ndarray] = deque(x, maxlen=most)
    for table in x:
        if max(table[j][j] for j in start) < n:
            kept.append(table)
    while True:
        table = np.minimum(np.maximum(lead[-1] + 1, after[lead[0]]), n)
        if max(table[j][j] for j in start) >= n:
            return np.stack([clock[t] for t in kept]) if kept else np.empty((0, most, len(y)), np.int64)
        lead.append(table)
        kept.append(table)


def _whole_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in the order of key and span as tables of whole spans, many to a table; where each span starts and ends."""
    held: list[pa.RecordBatch] = []
    last = None

    def table() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        out = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(_changes(out))
        return out, starts, np.append(starts[1:], out.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _changes(batch)
        new[0] = (batch["key"][0].as_py(), batch["span"][0].as_py()) != last
        last = batch["key"][-1].as_py(), batch["span"][-1].as_py()
        at = np.flatnonzero(new)
        if len(at):
            end = int(at[-1])
            held += [batch.slice(0, end)] if end else []
            if held:
                yield table()
            held = [batch.slice(end)]
        else:
            held.append(batch)
    if held:
        yield table()


def _changes(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """True where a row's key or span isn't that of the row before."""
    key, span = rows["key"].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows["key"].to_numpy(), rows["span"].to_numpy()
    out = np.ones(len(span), bool)
    out[1:] = (key[1:] != key[:-1]) | (span[1:] != span[:-1])
    return out


def _sum_up(batches: Iterator[pa.RecordBatch], most: int, window: int, length: int) -> Iterator[pa.RecordBatch]:
    """key, span, heads, last, ways of the spans of which something reaches into the next."""
    for rows, starts, ends in _whole_spans(batches):
        ms, span = rows["ms"].to_numpy(), rows["span"].to_numpy()
        begin = span * length
        n_heads = np.add.reduceat((ms < begin + window).astype(np.int64), starts)
        reach = np.flatnonzero(ms[ends - 1] >= begin[starts] + length - window)
        out = []
        for i in reach:
            times, n = ms[starts[i] : ends[i]], int(n_heads[i])
            if n:
                out.append((times[:n], [], _function(times, n, most, window).ravel()))
            else:
                out.append(([], times[_accepted(_after(times, window), _firsts(times, [], most, window))][-most:], []))
        if out:
            heads, last, ways = (pa.array(list(c), pa.list_(pa.int64())) for c in zip(*out, strict=True))
            first = pa.array(starts[reach])
            yield pa.RecordBatch.from_arrays([rows["key"].take(first).combine_chunks(), rows["span"].take(first).combine_chunks(), heads, last, ways], names=["key", "span", "heads", "last", "ways"])


def _walk(batches: Iterator[pd.DataFrame], most: int, window: int) -> Iterator[pd.DataFrame]:
    """Spans that reach into the next, by key and order; recent: the accepted times that reach into the span it is given for."""
    key, before, left = None, -1, []
    for pdf in batches:
        out = []
        for k, span, heads, last, ways in zip(pdf["key"], pdf["span"], pdf["heads"], pdf["last"], pdf["ways"], strict=True):
            recent = left if k == key and span == before + 1 else []
            key, before, left = k, span, [int(t) for t in last]
            if len(ways):
                heads = np.asarray(heads)
                firsts = _firsts(heads, recent, most, window)
                table = np.asarray(ways).reshape(-1, most, len(heads) + most)
                ends = np.max([table[:, j, p] for j, p in enumerate(firsts)], axis=0)
                left = [int(t) for t in ends if t < NEVER][-most:]
            if left:
                out.append((k, span + 1, left))
        yield pd.DataFrame(out, columns=["key", "span", "recent"])


def _decide(batches: Iterator[pa.RecordBatch], most: int, window: int) -> Iterator[pa.RecordBatch]:
    """Spans of no more attempts than may be accepted, into which nothing reaches, need no look."""
    for rows, starts, ends in _whole_spans(batches):
        ms, ok = rows["ms"].to_numpy(), np.ones(rows.num_rows, bool)
        recents = rows["recent"].take(pa.array(starts))
        hears = recents.is_valid().to_numpy()
        for i in np.flatnonzero((ends - starts > most) | hears):
            start, end = starts[i], ends[i]
            times, recent = ms[start:end], recents[int(i)].as_py() or []
            ok[start:end] = False
            ok[start + np.array(_accepted(_after(times, window), _firsts(times, recent, most, window)), np.int64)] = True
        yield from rows.select(["client", "ms", "seq"]).append_column("accepted", pa.array(ok)).to_batches()


def rate_limited(attempts: DataFrame, most: int = MAX_ACCEPTED, window: int = WINDOW_MS, windows: int = SPAN_WINDOWS) -> DataFrame:
    """attempts: client, ms, seq. Adds accepted. Only accepted attempts count against later ones, so each depends on all before it.

    No task holds more of a client than a span of `windows` windows and one span's table; the pass over a client's spans keeps `most` times. Attempts of one
    millisecond go by seq. A null client is a client; an attempt without a time isn't accepted; repeated rows are attempts of their own; other columns are dropped.
    """
    if most < 1 or window < 1 or windows < 1:
        raise ValueError("most, window and windows are at least 1")
    length = window * windows
    kinds = dict(attempts.dtypes)
    rows = attempts.select("client", F.col("ms").cast("long").alias("ms"), "seq")
    # a text for each client, as its column can have any type, and nulls
    text = F.hex("client") if kinds["client"] == "binary" else F.to_json(F.struct("client")) if kinds["client"].startswith(("struct", "array")) else F.col("client").cast("string")
    timed = rows.where("ms IS NOT NULL").withColumns({"key": F.coalesce(F.concat(F.lit("="), text), F.lit("")), "span": F.floor(F.col("ms") / F.lit(length)).cast("long")})
    parts = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as a span's table is few bytes and much work
    spans = timed.select("key", "span", "ms").repartition(parts, "key", "span").sortWithinPartitions("key", "span", "ms").mapInArrow(
        lambda batches: _sum_up(batches, most, window, length), "key string, span long, heads array<long>, last array<long>, ways array<long>")
    inward = spans.repartition(parts, "key").sortWithinPartitions("key", "span").mapInPandas(lambda batches: _walk(batches, most, window), "key string, span long, recent array<long>")
    known = timed.hint("merge").join(inward.hint("merge"), ["key", "span"], "left").repartition(parts, "key", "span").sortWithinPartitions("key", "span", "ms", "seq")
    out = known.mapInArrow(lambda batches: _decide(batches, most, window), f"client {kinds['client']}, ms long, seq {kinds['seq']}, accepted boolean")
    return out.unionAll(rows.where("ms IS NULL").withColumn("accepted", F.lit(False)))
