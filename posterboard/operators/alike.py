"""Pairs of alike keys out of two sets of distinct keys, without comparing all with all and without losing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy


def _pairs_of(key: Column) -> Column:
    """Pairs of neighbouring characters of a key, with a space at either end."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), key, F.lit(" ")), F.lit("(?=(..))"), F.lit(1)))


def _shared(length: Column, least: float) -> Column:
    """How many pairs of neighbours a key of so many characters has at least in common with a key that it is alike, if it is the shorter of the texts that are compared.

    Texts of n and w characters with a likeness of ``least`` have a common subsequence of l = least (n + w) / 2. It falls into at most 1 + (n - l) + (w - l) runs, so 3 l - 1 - n - w neighbours are in common;
    and w is at least n least / (2 - least), as l can't be over w. Words that are put in another order keep their pairs, as the ends of each word are pairs with a space. Keys of which one has
    all words of the other, or most of its characters in words that they share, have more in common.
    """
    return F.ceil((1.5 * least - 1) * 2 / (2 - least) * length - 1 - 1e-9)


def alike_pairs(left: DataFrame, right: DataFrame, least: float, likeness=fuzzy.key_likeness) -> DataFrame:
    """left, right: key. Returns a, b, likeness for keys with a likeness of least or more; blank keys are alike nothing.

    Of a key's pairs of neighbours all but the shared ones, and one more, must hold a shared one: the rarest so many are looked up among all pairs of the other side, and the other way round.
    Keys too short for that bound are looked up by their characters.
    """
    l, r = (df.select("key").where("key != ''").distinct() for df in (left, right))

    def all_of(keys: DataFrame) -> DataFrame:
        one = F.array_distinct(F.regexp_extract_all("key", F.lit("[^ ]"), F.lit(0)))
        return keys.select("key", F.explode(F.concat(_pairs_of(F.col("key")), one)).alias("part"))

    every = l.unionByName(r).distinct()
    counts = every.select(F.explode(_pairs_of(F.col("key"))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))

    def rare_of(keys: DataFrame) -> DataFrame:
        shared = _shared(F.length("key"), least)
        parts = keys.where(shared > 0).select("key", (F.length("key") + 2 - shared).alias("most"), F.explode(_pairs_of(F.col("key"))).alias("part")).join(counts, "part")
        order = Window.partitionBy("key").orderBy("n", "part")  # the pairs of one key
        rare = parts.withColumn("at", F.row_number().over(order)).where("at <= most").select("key", "part")
        one = F.array_distinct(F.regexp_extract_all("key", F.lit("[^ ]"), F.lit(0)))
        return rare.unionByName(keys.where(shared <= 0).select("key", F.explode(one).alias("part")))

    named = lambda df, name: df.select(F.col("key").alias(name), "part")
    meet = named(rare_of(l), "a").join(named(all_of(r), "b"), "part").select("a", "b")
    back = named(all_of(l), "a").join(named(rare_of(r), "b"), "part").select("a", "b")
    pairs = meet.unionByName(back).distinct()
    # what they share in all, before they are compared: a pair of neighbours that a key has twice counts once
    common = F.size(F.array_intersect(_pairs_of(F.col("a")), _pairs_of(F.col("b"))))
    bound = lambda c: _shared(F.length(c), least) - (F.length(c) + 1 - F.size(_pairs_of(F.col(c))))
    pairs = pairs.where(common >= F.least(bound("a"), bound("b")))
    # a stated number of partitions: pairs are few bytes and much work
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return pairs.withColumn("likeness", likeness(F.col("a"), F.col("b"))).where(F.col("likeness") >= least)
