"""Hard-negative mining over an inverted multi-index.

Vectors are cut into two halves with a codebook each; a pair of entries is a cell, and every row lies in one. No row of a cell can have a higher inner product with an anchor than the sum of two half scores: the
entry's own, and the anchor's half length times the entry's radius, the largest distance of any row to it. A multi-sequence heap gives an anchor's cells by falling sums, and an anchor stops at the first
cell whose sum is too low for what it still looks for, which is how its result is certified; nothing is approximate.

An anchor goes to cells three times: to its first few, for a score that its worst positive reaches at least; to all that can reach that score, for the positives; and to all that can reach a window below a
positive, for the negatives. Each time anchors meet rows in groups of one cell: a large cell is dealt into salts, and anchors into blocks, so that a group has a bound on either side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .vectors import integer_vectors, matrix, products

#: Entries of each half's codebook, and the rows that it is fitted on; every row is indexed, and codebooks only change how many cells are looked at.
ENTRIES, FIT_ROWS, FIT_ROUNDS = 16, 4096, 8
#: An anchor's first cells are those with about so many rows.
FIRST_ROWS = 2048
#: Rows and anchors of a group, about.
GROUP_ROWS, GROUP_ANCHORS = 4096, 1024
K, SCALE = 5, 256
#: A window below a positive's score s is from NEAR / 100 of s to s.
NEAR = 80


@dataclass
class Index:
    """books and radii of both halves; counts of rows by cell (first entry x second entry)."""

    books: list[np.ndarray]
    radii: list[np.ndarray]
    counts: np.ndarray

    def bounds(self, anchor: np.ndarray) -> list[np.ndarray]:
        """For each half, the highest score that a row of each entry can have, rounding included."""
        out, at = [], 0
        for book, radius in zip(self.books, self.radii, strict=True):
            half = anchor[at : at + book.shape[1]].astype(np.float64)
            at += book.shape[1]
            reach = np.linalg.norm(half) * radius
            own = book @ half
            out.append(own + reach + 1e-9 * (np.abs(book) @ np.abs(half) + reach) + 1e-6)
        return out

    def by_bound(self, anchor: np.ndarray) -> Iterator[tuple[int, float]]:
        """Cells that have rows, with their bounds, highest first: a heap over the two sorted sequences of half scores."""
        one, two = self.bounds(anchor)
        first, second = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap, seen = [(-(one[first[0]] + two[second[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            if self.counts[first[i], second[j]]:
                yield int(first[i]) * len(two) + int(second[j]), -bound
            for place in ((i + 1, j), (i, j + 1)):
                if place[0] < len(one) and place[1] < len(two) and place not in seen:
                    seen.add(place)
                    heapq.heappush(heap, (-(one[first[place[0]]] + two[second[place[1]]]), *place))

    def first_cells(self, anchor: np.ndarray) -> int:
        """How many of its cells an anchor goes to first."""
        rows, flat = 0, self.counts.reshape(-1)
        for n, (cell, _) in enumerate(self.by_bound(anchor), 1):
            rows += flat[cell]
            if rows >= FIRST_ROWS:
                break
        return n


def _fit(sample: np.ndarray, entries: int) -> np.ndarray:
    """A codebook of floats by plain rounds over the sample."""
    book = np.unique(sample, axis=0)
    book = book[np.linspace(0, len(book) - 1, min(entries, len(book))).astype(int)].astype(np.float64)
    for _ in range(FIT_ROUNDS):
        at = ((book**2).sum(axis=1)[None, :] - 2 * sample @ book.T).argmin(axis=1)
        sums, n = np.zeros_like(book), np.bincount(at, minlength=len(book))
        np.add.at(sums, at, sample)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def build(rows: DataFrame, width: int, entries: int = ENTRIES) -> tuple[DataFrame, Index]:
    """rows: vec_id, label, ints (width is even). Returns them with their cell, as a table, and the index."""
    half = width // 2
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("ints").collect()
    known = np.array([r["ints"] for r in sample], dtype=np.float64).reshape(-1, width)
    books = [_fit(known[:, :half], entries), _fit(known[:, half:], entries)]
    across = len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, cell, far = matrix(batch.column("ints"), width).astype(np.float64), 0, []
            for part, book in zip((whole[:, :half], whole[:, half:]), books, strict=True):
                at = ((book**2).sum(axis=1)[None, :] - 2 * part @ book.T).argmin(axis=1) if len(part) else np.zeros(0, dtype=int)
                cell = cell * across + at
                far.append(np.linalg.norm(part - book[at], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), pa.array(cell, type=pa.int32()), *map(pa.array, far)], names=["vec_id", "label", "ints", "cell", "far1", "far2"])

    kind = dict(rows.dtypes)["label"]
    indexed = written(rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id long, label {kind}, ints array<long>, cell int, far1 double, far2 double"), "multi-index")
    counts, radii = np.zeros((len(books[0]), across), dtype=np.int64), [np.zeros(len(b)) for b in books]
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect():  # a row for each pair of entries at most
        i, j = divmod(r["cell"], across)
        counts[i, j] = r["n"]
        radii[0][i], radii[1][j] = max(radii[0][i], r["far1"]), max(radii[1][j], r["far2"])
    return indexed.drop("far1", "far2"), Index(books, radii, counts)


#: What an anchor looks for: rows of its label with a score of low at least (null: any), and others with scores in [low_other, low]; or others in its windows, [NEAR / 100 s, s], from low_other on.
WANT = "low long, low_other long, windows array<long>"


def visits(anchors: DataFrame, index: Index, width: int, which: str) -> DataFrame:
    """A row for each anchor and cell that it goes to; which: first, positives or negatives."""

    def cells(anchor: np.ndarray, low: int | None, low_other: int | None) -> list[int]:
        order = index.by_bound(anchor)
        if which == "first":
            return [cell for cell, _ in islice(order, index.first_cells(anchor))]
        if which == "positives":
            order, least = islice(order, index.first_cells(anchor), None), low
        else:
            least = low_other
        out = []
        for cell, bound in order:
            if least is not None and bound < least:
                break  # certified: no cell after this one has a row that counts
            out.append(cell)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, low, other = matrix(batch.column("ints"), width), batch.column("low").to_pylist(), batch.column("low_other").to_pylist()
            for i in range(0, len(whole), 64):  # so that what goes out at a time has a bound
                found = [cells(*x) for x in zip(whole[i : i + 64], low[i : i + 64], other[i : i + 64], strict=True)]
                at = pa.array(np.repeat(np.arange(i, i + len(found)), [len(x) for x in found]), type=pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array([c for x in found for c in x], type=pa.int32())], names=[*names, "cell"])

    names = anchors.columns
    return anchors.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in anchors.dtypes) + ", cell int")


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of the places at with the highest scores, the earlier of equals first."""
    own = scores[at]
    if len(at) > k:
        least = np.partition(own, len(own) - k)[len(own) - k]
        at, own = at[own >= least], own[own >= least]
    return at[np.argsort(-own, kind="stable")][:k]


def meet(indexed: DataFrame, wanted: DataFrame, index: Index, width: int, k: int, which: str) -> DataFrame:
    """wanted: visits. Each anchor's best rows of each cell that it goes to: anchor_id, find (0 for its own label, 1 for others), upto (the window's score, 0 where there is none), score, vec_id."""
    salts = F.array(*[F.lit(int(max(1, -(-n // GROUP_ROWS)))).cast("long") for n in index.counts.reshape(-1)])
    blocks = max(1, -(-wanted.select("vec_id").distinct().count() // GROUP_ANCHORS))
    of_cell = F.element_at(salts, F.col("cell") + 1)
    left = indexed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), of_cell)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), of_cell - 1)))

    def run(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            rows = rows.sort_by("vec_id")  # equal scores go by the smaller id
            ids, whole = rows.column("vec_id").to_numpy(), matrix(rows.column("ints"), width)
            numbers = {}  # labels may be of any type
            labels = np.array([numbers.setdefault(x, len(numbers)) for x in rows.column("label").to_pylist()])
            mine = matrix(anchors.column("ints"), width)
            who, label, low, other, windows = (anchors.column(c).to_pylist() for c in ("vec_id", "label", "low", "low_other", "windows"))
            for start in range(0, len(mine), 64):
                for i, scores in enumerate(products(mine[start : start + 64], whole), start):
                    same = labels == numbers.get(label[i], -1)
                    if which == "negatives":
                        pool = np.flatnonzero(~same & (scores >= other[i]) & (scores <= max(windows[i])))
                        for s in windows[i]:
                            fits = pool[(scores[pool] <= s) & (100 * scores[pool] >= NEAR * s)]
                            found += [(who[i], 1, s, int(scores[j]), int(ids[j])) for j in _best(scores, fits, k)]
                        continue
                    pool = same & (ids != who[i])
                    if low[i] is not None:
                        pool &= scores >= low[i]
                        below = np.flatnonzero(~same & (scores >= other[i]) & (scores <= low[i]))
                        found += [(who[i], 1, 0, int(scores[j]), int(ids[j])) for j in _best(scores, below, k)]
                    found += [(who[i], 0, 0, int(scores[j]), int(ids[j])) for j in _best(scores, np.flatnonzero(pool), k)]
        columns = list(zip(*found, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "find", "upto", "score", "vec_id"])

    key = ["cell", "salt", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "anchor_id long, find int, upto long, score long, vec_id long")


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, vector: str = "embedding", k: int = K, scale: int = SCALE, entries: int = ENTRIES) -> DataFrame:
    """rows: vec_id (long), label and a vector; is_anchor says which rows are anchors. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x). An anchor's positives are its k best other rows of the same label; for each of them, its k best rows of other labels with a score from NEAR / 100 of the
    positive's to the positive's. Equal scores go by the smaller id. A positive with a negative score has no window.

    Rows take no part whose id, label or vector is null, or whose vector has a null or non-finite component. Of rows with one id the one with the smallest label, then vector, counts, so repeated
    rows count once. Shorter vectors count as followed by zeros; other columns (texts of any length) are ignored; an empty table, or one without anchors, gives no rows. A scaled component beyond
    2**31 is an error.
    """
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", "label", F.col(vector).alias("ints"), is_anchor.alias("chosen"))
    whole, width = integer_vectors(rows, "ints", scale, 2)
    whole = whole.groupBy("vec_id").agg(F.min(F.struct("label", "ints", "chosen")).alias("r")).select("vec_id", "r.label", "r.ints", "r.chosen")
    whole = written(whole, "vectors")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if whole.isEmpty():
        return rows.sparkSession.createDataFrame([], out)
    indexed, index = build(whole, width, entries)
    anchors = whole.where("chosen").drop("chosen")
    want = lambda df, low, other, windows: df.select("vec_id", "label", "ints", low.cast("long").alias("low"), other.cast("long").alias("low_other"), windows.cast("array<long>").alias("windows"))
    nothing = F.lit(None)

    go = lambda df, which: meet(indexed, visits(df, index, width, which), index, width, k, which)
    first = written(_top(go(want(anchors, nothing, nothing, nothing), "first"), k, "anchor_id"), "first")
    low = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("lowest"))
    second = want(anchors.join(low, "vec_id", "left"), F.col("lowest"), F.ceil(F.col("lowest") * NEAR / 100), nothing)
    both = first.drop("rank").unionByName(go(second, "positives"))
    found = written(_top(both, k, "anchor_id", "find"), "found")
    positives = found.where("find = 0").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # k rows of other labels at or below the worst positive bound every window from below
    below = found.where("find = 1").groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("below"))
    windows = positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("windows")).join(below, "anchor_id", "left")
    third = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    least = F.ceil(F.element_at("windows", 1) * NEAR / 100)
    third = want(third, nothing, F.greatest(least, "below"), F.col("windows"))
    negatives = _top(go(third, "negatives"), k, "anchor_id", "upto")
    return positives.join(negatives.withColumnRenamed("upto", "positive_score"), ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {K}),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {NEAR} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= {K}
"""
