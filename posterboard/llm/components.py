"""Connected components of a graph that is a DataFrame of edges: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The edges of one node are dealt into so many parts wherever they meet that node's row, as a hub may have most of all edges.
SALT = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) beside least (u, m)."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(salted, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """edges: two long columns. Returns node, root: the smallest node of each node's component (of nodes that have an edge to another).

    Each round gives every node's larger neighbours (large star), then its smaller ones (small star), to the smallest of them, until all that is left
    are stars; that takes about the logarithm of the number of nodes rounds. Each round's edges are a table in the shared folder. One number of a round reaches the driver.
    """

    def only_stars(df: DataFrame) -> bool:
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(df.select("v", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).alias("n")).first()["n"] == 0

    # u > v in every row
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    while not only_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
