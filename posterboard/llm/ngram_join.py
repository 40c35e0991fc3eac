"""N-gram Jaccard join: which documents' sets of word n-grams are alike, as T-occurrence search with DivideSkip.

1. Each text's set of n-gram hashes is made; equal sets are one node from then on.
2. Two sets of x and y n-grams that link share at least T = ceil(J / (1 + J) * (x + y)) of them. Of the first n - ceil(J * n) + l(n) hashes of
   each, ascending, they share l at least, l a small part of n; and of these, with the rarest first, one is among the first few of both (the prefix rule, applied twice).
   So only a small part of the hashes is counted, and hashes that a single set has - nearly all - go no further.
3. Sets that share such a hash form groups. Sets of different groups can't link. A large group is dealt into blocks, and each pair of blocks is a unit of work.
4. In a unit, inverted lists are made of whole sets. For each query set the longest lists are put aside; the others are merged, sets that occur T - L
   times are kept, and looked up in the L long lists by binary search.
5. A unit gives each set's number of links and one link to a representative, never all pairs. The components of those are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import components

#: Percent: two sets link if 100 * common >= THRESHOLD * union.
THRESHOLD = 90
WORDS = 3
#: Rows of a block of a large group: a group has at most BLOCKS blocks until they have LARGE rows, so a set goes to at most BLOCKS units till then.
BLOCK, BLOCKS, LARGE = 128, 8, 4096
#: And n-grams of a block, so that a unit of very long texts fits in memory.
BLOCK_GRAMS = 3_000_000
#: How much longer a set's first part is than the prefix rule asks for: a percentage of the set, and some n-grams more, which short sets need
#: to have enough n-grams of their own beside a passage that many share. Two sets that link share so many n-grams of their first parts.
MARGIN, EXTRA = 8, 16
#: Weight of a binary search against a step of the merge, in the rule that says how many lists are long.
MU = 0.02
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def ngram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    s = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        s = s * _P + h[k : len(words) - n + 1 + k]
        s ^= s >> np.uint64(29)
    s = (s ^ (s >> np.uint64(33))) * _M1
    s = (s ^ (s >> np.uint64(29))) * _M2
    return np.unique(s ^ (s >> np.uint64(32)))


def least_common(x: int, threshold: int) -> int:
    """The fewest n-grams that a set of x shares with any set it links to."""
    return -(-threshold * x // 100)


def margin(x: int, threshold: int) -> int:
    """l(x): how many n-grams the first parts of a set and one it links to share at least."""
    return min(-(-MARGIN * x // 100) + EXTRA, least_common(x, threshold))


def first_part(x: int, threshold: int) -> int:
    return min(x, x - least_common(x, threshold) + margin(x, threshold))


def _sets(docs: DataFrame, threshold: int, n: int) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            out = []
            for doc_id, text, th in zip(pdf["doc_id"], pdf["text"], pdf["text_hash"], strict=True):
                s = ngram_set(text, n)
                d = xxhash.xxh3_128_digest(s.tobytes())
                first = s[: first_part(len(s), threshold)].view(np.int64)
                out.append((row, doc_id, th, len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), first))
                row += 1
            yield pd.DataFrame(out, columns=["row", "doc_id", "text_hash", "n", "d1", "d2", "first"])

    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    out = rows.mapInPandas(make, "row long, doc_id string, text_hash long, n long, d1 long, d2 long, first array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _groups(sets: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """row, grp for the sets that share an indexed n-gram with another. nodes: sets without the further copies."""
    grams = nodes.select("row", "n", F.explode("first").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = grams.join(shared, "gram").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))  # within a document
    n = F.col("n").cast("int")
    percent = lambda p, of: F.floor((F.lit(p) * of + 99) / 100).cast("int")  # noqa: E731  rounded up
    least = percent(threshold, n)
    common = lambda of: F.least(percent(MARGIN, of) + EXTRA, percent(threshold, of))
    spare = F.least(n, n - least + common(n)) - F.size("grams")  # n-grams of this set alone, which come first
    # a partner may be as short as least, and share as few as that length's margin
    take = F.greatest(n - least + common(n) - common(least) + 1 - spare, F.lit(0))
    index = written(mine.select("row", F.explode(F.slice("grams", F.lit(1), take)).alias("g")).select("row", F.col("g.gram").alias("gram")), "index")
    hubs = index.groupBy("gram").agg(F.min("row").alias("hub"))
    links = index.join(hubs, "gram").where("row != hub").select("row", "hub")
    return components(links, "row", "hub").select(F.col("node").alias("row"), F.col("root").alias("grp"))


def link_counts(sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each set: the weight of the sets it links to, and a representative of those it reaches.

    left: True for sets that are compared with those where it is False; if all are alike, each is compared with each.
    """
    m = len(sets)
    links, parent = np.zeros(m, dtype=np.int64), np.arange(m)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    within = left.all() or not left.any()
    size = np.array([len(s) for s in sets])
    target = np.arange(m) if within else np.flatnonzero(~left)
    grams = np.concatenate([sets[i] for i in target])
    owner = np.repeat(target, size[target])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    keys, starts = np.unique(grams, return_index=True)
    ends = np.append(starts[1:], len(grams))
    for i in range(m) if within else np.flatnonzero(left):
        x, need = sets[i], least_common(len(sets[i]), threshold)
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        at = at[keys[at] == x]
        length = ends[at] - starts[at]
        if within:  # a list with this set alone says nothing
            at, length = at[length > 1], length[length > 1]
        if len(at) < need:
            continue
        by_length = np.argsort(length, kind="stable")
        at, length = at[by_length], length[by_length]
        n_long = min(need - 1, int(need / (MU * np.log2(max(2, length[-1])) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        # the short lists are ascending runs, which the stable sort merges
        merged = np.sort(np.concatenate([owner[starts[k] : ends[k]] for k in short]), kind="stable")
        found, count = np.unique(merged, return_counts=True)
        ok = (count >= need - n_long) & (found > i if within else found >= 0)
        ok &= (100 * size[found] >= threshold * len(x)) & (100 * len(x) >= threshold * size[found])
        found, count = found[ok], count[ok]
        if not len(found):
            continue
        if n_long:
            total = int((ends[long] - starts[long]).sum())
            if len(found) * n_long * np.log2(max(2, length[-1])) < total * 16:
                wanted = keys[long]
                for c, j in enumerate(found):  # binary search: is the candidate in each long list?
                    p = np.searchsorted(sets[j], wanted)
                    p[p == len(sets[j])] = 0
                    count[c] += int((sets[j][p] == wanted).sum())
            else:  # so many candidates that reading the lists through is less
                seen = np.bincount(np.concatenate([owner[starts[k] : ends[k]] for k in long]), minlength=m)
                count = count + seen[found]
        for j in found[(100 + threshold) * count >= threshold * (len(x) + size[found])]:
            links[i] += weights[j]
            links[j] += weights[i]
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(m)])


def _compare(units: DataFrame, threshold: int) -> DataFrame:
    """units: unit, side, row, weight, set; rows of a unit come together. Returns row, links, root, one row for each set of a unit."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        rows = list({r[1]: r for r in rows}.values())  # a document's repeated rows have one set
        rows.sort(key=lambda r: r[1])
        links, root = link_counts([np.frombuffer(r[3], "<u8") for r in rows], np.array([r[2] for r in rows]), np.array([r[0] == 0 for r in rows]), threshold)
        ids = np.array([r[1] for r in rows])
        return pd.DataFrame({"row": ids, "links": links, "root": ids[root]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, rows = None, []
        for pdf in batches:
            out = []
            for u, *rest in pdf[["unit", "side", "row", "weight", "set"]].itertuples(index=False, name=None):
                if u != unit:
                    if len(rows) > 1:
                        out.append(solve(rows))
                    unit, rows = u, []
                rows.append(tuple(rest))
            if out:
                yield pd.concat(out)
        if len(rows) > 1:
            yield solve(rows)

    parts = units.repartition("unit").sortWithinPartitions("unit")
    return parts.mapInPandas(run, "row long, links long, root long")


def similarity_classes(docs: DataFrame, threshold: int = THRESHOLD, n: int = WORDS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, n_copies, n_links: one row per row of docs.

    component_id: the smallest doc_id that links reach; n_copies: rows with the same set, itself included; n_links: other rows it links to, copies included.
    Null or empty texts, and texts without words, have no n-grams and are classes of their own; so is any row with a null doc_id whose set no
    other row is like. Repeated rows are copies of each other. Other columns are ignored; an empty table gives no rows.
    """
    sets = written(_sets(docs, threshold, n), "sets")
    copies = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    copies = written(copies.where("weight > 1"), "copies")
    further = written(sets.join(copies, ["d1", "d2"]).where("row != rep").select("row"), "further-copies")
    nodes = sets.where("n > 0").join(further, "row", "left_anti")
    groups = written(_groups(sets, nodes, threshold), "groups")

    # units of work
    sizes = groups.join(sets.select("row", "n"), "row").groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.least(F.ceil(F.col("m") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("m") / LARGE), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    members = groups.join(sizes.select("grp", blocks.alias("blocks")), "grp").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    facts = sets.select("row", "doc_id", "text_hash", "d1", "d2").join(members, "row").join(copies.select("d1", "d2", "weight"), ["d1", "d2"], "left")
    facts = written(facts.select("row", "doc_id", "text_hash", "grp", "blocks", "block", F.coalesce("weight", F.lit(1)).alias("weight")), "members")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(set=[ngram_set(t, n).tobytes() for t in pdf["text"]])

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("_id")).withColumn("_h", F.xxhash64("text"))
    # the table of members grows with the input, so it isn't broadcast
    whole = facts.hint("merge").join(text, (facts["text_hash"] == text["_h"]) & facts["doc_id"].eqNullSafe(text["_id"])).select("row", "weight", "grp", "blocks", "block", "text")
    whole = whole.mapInPandas(hashed, "row long, weight long, grp long, blocks int, block int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = whole.select("row", "weight", "set", "grp", "blocks", "block", other).select(
        F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "row", "weight", "set"
    )
    found = written(_compare(units, threshold), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    linked = components(found.where("row != root"), "row", "root")

    # from nodes to classes, and to all rows
    nodes = sets.where("n > 0").select("row", "d1", "d2", "doc_id").join(linked.select(F.col("node").alias("row"), "root"), "row")
    nodes = nodes.join(links, "row").join(copies.select("d1", "d2", "first_id"), ["d1", "d2"], "left").withColumn("first_id", F.coalesce("first_id", "doc_id"))
    smallest = nodes.groupBy("root").agg(F.min("first_id").alias("component"))
    classes = nodes.join(smallest, "root").select("d1", "d2", "component", "links")
    out = sets.select("doc_id", "n", "d1", "d2").join(copies.select("d1", "d2", "first_id", "weight"), ["d1", "d2"], "left").join(classes, ["d1", "d2"], "left")
    weight = F.coalesce("weight", F.lit(1))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first_id", "doc_id").alias("component_id"),
        weight.alias("n_copies"), (F.coalesce("links", F.lit(0)) + weight - 1).alias("n_links"),
    )


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, n: int = WORDS) -> DataFrame:
    """The rows of docs with the smallest doc_id of their class, all columns; of repeated rows one stays. Rows with a null doc_id stay."""
    classes = similarity_classes(docs, threshold, n)
    first = written(classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "first-of-class")
    again = first.where("rows > 1").select("doc_id")
    kept = docs.join(first.where("rows = 1"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    if not again.isEmpty():
        kept = kept.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))
