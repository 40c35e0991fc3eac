"""Packing: length buckets whose bounds dynamic programming chooses to minimise padding; token-budget batches inside.

The histogram of lengths covers all documents, each distinct length by itself, and the bounds are the best whatever their number. Up to MAX_LENGTHS distinct lengths the driver chooses
the bounds; more of them stay in a table, whose blocks are solved in parallel, level by level, with the same bounds as outcome (ties included). So the driver gets a bounded number of
rows whatever the input. All else stays in DataFrames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import n_words, table, written

#: Distinct lengths that the driver takes, or a block of the table of lengths holds; and significant bits of the cells that blocks are made of, at most 2**11 for each doubling.
MAX_LENGTHS, PRECISION = 65_536, 12
N_BUCKETS = 16
TOKEN_BUDGET = 16_384
SHARD_ROWS = 4_096
RESULT = ("n_tokens", "bucket", "bucket_len", "batch", "slot", "capacity")


def rounded_length(n: Column, precision: int = PRECISION) -> Column:
    """n rounded up to precision significant bits."""
    bits = F.greatest(F.length(F.bin(n)) - precision, F.lit(0))
    unit = F.expr("1L").cast("long") * F.pow(F.lit(2.0), bits).cast("long")
    return (F.ceil(n / unit) * unit).cast("long")


def cheapest(lines: tuple[np.ndarray, np.ndarray], n: np.ndarray, rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, at) of each length n: the least of best[i] + n * (rows - upto[i]) over the first before[.] lines (upto, best), and the first i that has it; infinity and -1 where there is none.

    All in ascending order. The best i doesn't fall as n grows, so this goes by halving: the middle length first, then either side within the bounds that it sets.
    """
    upto, best = lines
    cost, at = np.full(len(n), np.inf), np.full(len(n), -1)
    todo = [(0, len(n) - 1, 0, len(upto))]
    while todo:
        lo, hi, first, last = todo.pop()
        if lo > hi:
            continue
        j = (lo + hi) // 2
        end = min(last, before[j])
        if end <= first:  # nothing is before this length, nor before shorter ones
            todo.append((j + 1, hi, first, last))
            continue
        costs = best[first:end] + n[j] * (rows[j] - upto[first:end])
        i = first + int(np.argmin(costs))
        cost[j], at[j] = costs[i - first], i
        todo += [(lo, j - 1, first, i + 1), (j + 1, hi, i, last)]
    return cost, at


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets buckets over ascending lengths, with the least padding in all.

    Tokens after padding: best[k][j] = min over i < j of best[k-1][i] + lengths[j] * count(i+1..j). Whole numbers in doubles, so exact below 2**53 padded tokens.
    """
    m = len(lengths)
    if m == 0:
        return []
    lengths, rows = lengths.astype(np.float64), np.cumsum(counts.astype(np.float64))
    best, choice = lengths * rows, []
    for _ in range(min(n_buckets, m) - 1):
        cost, at = cheapest((rows, best), lengths, rows, np.arange(m))
        choice.append(np.where(cost < best, at, -1))
        best = np.minimum(cost, best)
    bounds, j = [], m - 1
    for at in reversed(choice):
        if at[j] >= 0:
            bounds.append(int(lengths[j]))
            j = int(at[j])
    bounds.append(int(lengths[j]))
    return sorted(set(bounds))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lengths of one block after the shorter ones of one block."""
    pdf = pdf.sort_values("n")
    ours, lines = pdf[pdf["ours"]], pdf[~pdf["ours"]]
    n, shorter = ours["n"].to_numpy(), lines["n"].to_numpy()
    cost, at = cheapest((lines["upto"].to_numpy(np.float64), lines["best"].to_numpy()), n.astype(np.float64), ours["upto"].to_numpy(np.float64), np.searchsorted(shorter, n))
    there = at >= 0
    return pd.DataFrame({"n": n[there], "cost": cost[there], "at": shorter[at[there]]})


def distributed_bounds(hist: DataFrame, n_buckets: int) -> list[tuple[int, int]]:
    """hist: n, rows. (bound, rows up to it) of the bounds that optimal_bounds gives, for any number of lengths: no task holds more than two blocks of about MAX_LENGTHS lengths.

    A level is solved block against block. Where the best i of the last length of each block lies is found first; those of a block's other lengths lie between its own and that of the
    block before, so there are at most twice as many pairs of blocks as blocks.
    """
    spark = hist.sparkSession
    cell = rounded_length(F.col("n"), PRECISION)
    cells = sorted(map(tuple, hist.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)), F.sum("rows")).collect()))
    sizes = np.cumsum([c for _, c, _ in cells])
    of_cell = [(x, int((s - 1) // MAX_LENGTHS), int(r)) for (x, _, _), s, r in zip(cells, sizes, np.cumsum([0, *(r for _, _, r in cells[:-1])]), strict=True)]
    placed = hist.withColumn("cell", cell).join(F.broadcast(spark.createDataFrame(of_cell, "cell long, block int, earlier long")), "cell")
    upto = F.col("earlier") + F.sum("rows").over(Window.partitionBy("cell").orderBy("n"))
    now = written(placed.select("block", "n", upto.alias("upto")).withColumn("best", F.col("n").cast("double") * F.col("upto")).withColumn("at", F.lit(None).cast("long")), "lengths-1")
    ends = [(r["block"], *r["end"]) for r in now.groupBy("block").agg(F.max(F.struct("n", "upto")).alias("end")).orderBy("block").collect()]
    last = spark.createDataFrame(ends, "end int, end_n long, end_upto long")
    levels = [now]
    for k in range(2, min(n_buckets, int(sizes[-1])) + 1):
        cost = F.col("best") + F.col("end_n").cast("double") * (F.col("end_upto") - F.col("upto"))
        found = now.crossJoin(F.broadcast(last)).where("n < end_n").groupBy("end").agg(F.min(F.struct(cost.alias("cost"), "n", "block"))["block"].alias("block"))
        best_of = {r["end"]: r["block"] for r in found.collect()}
        pairs, low = [], 0
        for block, _, _ in ends:
            high = best_of.get(block, 0)
            for b in range(low, high + 1):
                pairs += [(len(pairs) // 2, block, True), (len(pairs) // 2, b, False)]
            low = high
        units = now.join(F.broadcast(spark.createDataFrame(pairs, "unit int, block int, ours boolean")), "block")
        found = units.groupBy("unit").applyInPandas(_solve, "n long, cost double, at long").groupBy("n").agg(F.min(F.struct("cost", "at")).alias("found"))
        better = F.col("found.cost") < F.col("best")
        now = now.drop("at").join(found, "n", "left").select("block", "n", "upto", F.when(better, F.col("found.cost")).otherwise(F.col("best")).alias("best"), F.when(better, F.col("found.at")).alias("at"))
        now = written(now, f"lengths-{k}")
        levels.append(now)
    bounds, n = [], ends[-1][1]
    for level in reversed(levels):
        row = level.where(F.col("n") == n).first()
        if row["at"] is not None or level is levels[0]:
            bounds.append((n, row["upto"]))
            n = row["at"]
    return bounds[::-1]


def chosen_bounds(lengths: DataFrame, column: str, n_buckets: int) -> list[tuple[int, int]]:
    """(bound, rows up to it) of the buckets over all rows, ascending."""
    hist = lengths.groupBy(F.col(column).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    found = sorted(map(tuple, hist.limit(MAX_LENGTHS + 1).collect()))
    if len(found) > MAX_LENGTHS:
        return distributed_bounds(written(hist, "histogram"), n_buckets)
    n, counts = np.array(found, dtype=np.int64).reshape(-1, 2).T
    bounds = optimal_bounds(n, counts, n_buckets)
    return [(b, int(counts[n <= b].sum())) for b in bounds]


def pack(docs: DataFrame, key: str, length: Column, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Returns key, n_tokens, bucket, bucket_len, batch, slot, capacity: one row per row of docs.

    Every batch of a bucket is padded to bucket_len, the longest length in it, and holds floor(token_budget / bucket_len) rows. Texts stay whole: in a bucket whose bucket_len is over the
    budget each row is a batch of its own. Only the last batch of a bucket may hold fewer rows. Rows of a bucket are numbered shard by shard (shards by the
    key's hash, about SHARD_ROWS rows each, so that no task has to sort a whole bucket), then by key.
    Null or empty texts, and null lengths, have length 0 and fall into the first bucket; repeated keys get a slot each. Other columns of docs are ignored; the key may not be named
    as a column of the result. An empty table gives no rows.
    """
    if key in RESULT:
        raise ValueError(f"the key is named as a column of the result: {key}")
    spark = docs.sparkSession
    # the lengths are made once
    rows = written(docs.select(F.col(key).alias("_key"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")), "lengths")
    chosen = chosen_bounds(rows, "n_tokens", n_buckets)
    bounds = [b for b, _ in chosen]  # lengths of rows, so each is the longest of its bucket
    schema = "bucket int, bucket_len long, capacity long, shards long"
    info = [(k, b, max(1, token_budget // max(1, b)), max(1, -(-(upto - (chosen[k - 1][1] if k else 0)) // SHARD_ROWS))) for k, (b, upto) in enumerate(chosen)]
    buckets = spark.createDataFrame(info, T.StructType.fromDDL(schema))  # at most n_buckets rows
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_key"), F.col("shards")))
    sizes = rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("_key", "n_tokens")) - 1)
    at = F.col("offset") + F.col("rn")
    return numbered.join(offsets, ["bucket", "shard"]).select(
        F.col("_key").alias(key), "n_tokens", "bucket", "bucket_len",
        F.floor(at / F.col("capacity")).cast("long").alias("batch"),
        (at % F.col("capacity")).cast("long").alias("slot"),
        F.col("capacity"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, "doc_id", n_words(F.col("text")))
