"""Document fingerprints: SpotSigs. Built-in functions only.

A signature is an anchor (a very common word, the last one before a content word) and the chain of the two content words that follow it,
common words between them left out. A document's fingerprint is its set of signature hashes. Likeness is Jaccard, pruned by set length:
two sets can't be more alike than the shorter's length is to the longer's.

similarity_classes joins all sets: equal sets are one node; each set is indexed by its rarest signatures, as many as must hold one shared with any set that is
alike enough, within partitions by set length, where a set meets its own class and the next; a signature of many sets is dealt into salts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, table, written
from .components import components

#: Anchors of four languages.
ANCHORS = (
    "the of and to in a is that it for was on with as be by this are from at or not but have "
    "der die das und zu den von ist nicht ein eine mit auf dem des sich als im für "
    "de la que el en los se del las un por con una su para es al lo no "
    "le les et du une est dans qui pour pas sur au plus par il elle"
).split()


def _prefix_tree(words: list[str]) -> str:
    """A pattern for any of the words that looks at each character once, the longest first."""
    first: dict[str, list[str]] = {}
    for w in words:
        if w:
            first.setdefault(w[0], []).append(w[1:])
    parts = [ch + _prefix_tree(rest) for ch, rest in sorted(first.items())]
    if not parts:
        return ""
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in words else "")


_ANY = _prefix_tree(sorted(set(ANCHORS)))
_DROPPED = ".,;:!?\"'()[]"
#: A character of a word.
_CONTENT = "[^ \t\n\x0b\x0c\r" + re.escape(_DROPPED) + "]"
#: Sets that meet all others of one signature and length class in one place.
SALT_ROWS = 512
#: Percent: near duplicates are at least so alike.
THRESHOLD = 80
#: Rows that share a window when each document meets the next.
CELL_ROWS = 512


def normal_text(text: Column) -> Column:
    """Lower-cased (A-Z), without punctuation, words apart by single spaces, with one at either end."""
    spaces = "\t\n\x0b\x0c\r"
    flat = F.translate(text, UPPER + spaces + _DROPPED, LOWER + " " * len(spaces))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(flat, " {2,}", " ")), F.lit(" "))


def signatures(text: Column) -> Column:
    """array<int>: the distinct signature hashes, ascending. A text without signatures has one, of all its words; null counts as empty."""
    normal = normal_text(F.coalesce(text, F.lit("")))
    # of neighbouring anchors the last stays
    single = F.regexp_replace(normal, f"(?<= ){_ANY} (?={_ANY} )", "")
    chains = F.regexp_extract_all(single, F.lit(f"(?<= )(?=({_ANY} [^ ]+ (?:{_ANY} )?+[^ ]+) )"), F.lit(1))
    hashes = F.transform(chains, lambda c: F.hash(F.regexp_replace(c, f"(?<= ){_ANY} ", "")))
    return F.sort_array(F.array_distinct(F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.hash(normal)))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), " ")


def length_class(size: Column, threshold: float) -> Column:
    """The partition of a set length: sets in classes more than one apart can't be as alike as threshold. Classes are a little wider than they need be, for rounding."""
    return F.floor(F.log(size) / (F.log(F.lit(1 / threshold)) * (1 + 1e-9))).cast("int")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without comparing them if their lengths keep it under threshold."""
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(bound < threshold, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds sigs array<int> and fingerprint to docs, which needs text. Equal texts have equal fingerprints."""
    return docs.withColumn("sigs", signatures(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("sigs")))


def _index(sets: DataFrame, threshold: int) -> DataFrame:
    """sets: row, n, sigs, weight. A row for each of the rarest signatures of a set that other sets have too, with its place (at) among all of the set by rarity.

    A set of n signatures that is alike enough to another misses n - ceil(threshold * n / 100) of its own at most, so one more holds a shared one.
    """
    one = sets.select("row", F.explode("sigs").alias("sig"))
    frequency = one.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = one.join(frequency, "sig").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("ranked"))
    first = F.size("ranked") - F.ceil(F.size("ranked") * threshold / 100).cast("int") + 1
    ranked = ranked.select("row", F.slice("ranked", F.lit(1), first).alias("first"))
    facts = ranked.where(F.exists("first", lambda e: e.df > 1)).join(sets, "row").withColumn("owners", F.col("first.sig"))
    return facts.select("row", "n", "weight", "sigs", "owners", F.posexplode("first").alias("at", "e")).where("e.df > 1").select(
        "row", "n", "weight", "sigs", "owners", "at", F.col("e.sig").alias("sig"), F.greatest(F.lit(1), F.ceil(F.col("e.df") / SALT_ROWS)).cast("int").alias("salts"))


def links(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """sets: row, n (their size), sigs (distinct), weight. Returns a, b, weight_a, weight_b: each pair of sets that are at least threshold percent alike, once.

    A pair is found under the rarest signature that both are indexed by, and compared there, so none is found twice and none is carried on unless it is a link.
    """
    index = written(_index(sets, threshold).withColumn("cls", length_class(F.col("n"), threshold / 100)), "spot-index")  # read twice
    side = lambda df, x: df.select("cls", "sig", "salt", *[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "weight", "sigs", "owners", "at")])
    shorter = index.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).withColumn("cls", F.explode(F.array("cls", F.col("cls") + 1)))
    longer = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    both = side(shorter, "a").hint("merge").join(side(longer, "b"), ["cls", "sig", "salt"])  # neither side has a bound to be broadcast
    both = both.where("n_a < n_b OR (n_a = n_b AND row_a < row_b)").where(F.col("n_a") * 100 >= F.col("n_b") * threshold)
    # as many as can be shared from this signature on
    ahead = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    both = both.where(ahead * (100 + threshold) >= (F.col("n_a") + F.col("n_b")) * threshold)
    both = both.where(F.element_at(F.array_intersect("owners_a", "owners_b"), 1) == F.col("sig"))
    alike = F.size(F.array_intersect("sigs_a", "sigs_b")) * (100 + threshold) >= (F.col("n_a") + F.col("n_b")) * threshold
    return both.where(alike).select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "weight_a", "weight_b")


def similarity_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_signatures, class_id, n_copies, n_links: one row per row of docs.

    Two documents link if their sets of signatures are at least threshold percent alike. class_id: the smallest doc_id that links reach; n_copies: rows with
    the same set, itself included; n_links: other rows it links to, copies included. Null and empty texts, and texts without words, have no
    signatures and are classes of their own, as is a row with a null doc_id that none is like. Repeated rows are copies; very long texts are sets like others, whole;
    other columns are ignored; an empty table gives no rows. Links between different sets are a table in the shared folder, a row of four numbers each.
    """
    if not 0 < threshold < 100:
        raise ValueError("threshold is over 0 and under 100 percent")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.expr("CAST(array() AS array<int>)")
    sets = docs.select("doc_id", F.when(F.rlike("text", F.lit(_CONTENT)), signatures(F.col("text"))).otherwise(none).alias("sigs"))
    sets = sets.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sigs", F.size("sigs").alias("n"), F.xxhash64("sigs").alias("d1"), F.xxhash64(F.lit(1), F.col("sigs")).alias("d2"))
    sets = written(sets, "spot-sets")
    copies = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    copies = written(copies, "spot-nodes")
    nodes = sets.select("row", "n", "sigs").join(copies.select(F.col("rep").alias("row"), "weight"), "row")
    found = written(links(nodes, threshold), "spot-links")
    counts = found.select(F.col("a").alias("rep"), F.col("weight_b").alias("w")).unionAll(found.select("b", "weight_a")).groupBy("rep").agg(F.sum("w").alias("links"))
    roots = components(found, "a", "b").select(F.col("node").alias("rep"), "root")
    linked = copies.join(roots.join(counts, "rep"), "rep")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("smallest"))
    classes = linked.join(smallest, "root").select("rep", "smallest", "links")
    told = copies.join(classes, "rep", "left").where("weight > 1 OR smallest IS NOT NULL").drop("rep")
    out = sets.select("doc_id", "n", "d1", "d2").join(told, ["d1", "d2"], "left")
    weight = F.coalesce("weight", F.lit(1))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_signatures"), F.coalesce("smallest", "first_id", "doc_id").alias("class_id"),
        weight.alias("n_copies"), (F.coalesce("links", F.lit(0)) + weight - 1).alias("n_links"),
    )


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], payload: list[str]) -> DataFrame:
    """docs: doc_id, text (not null). Applies derive, and adds next_<column> for each payload column: the values of the next row, descending doc_id.

    After the last row comes the first. Rows with the same doc_id go by a hash of the text, and null ids come last (beside the smallest long, where that is an id). The first payload
    column is never null. No window holds all rows: ids are dealt into cells of about CELL_ROWS neighbours, and the last row of a cell gets the
    first row of the next cell that has any.
    """
    facts = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = max((facts["lo"] or 0) - 1, -(2**63)), facts["hi"] or 0
    width = max(1, (hi - lo + 1) * CELL_ROWS // max(1, facts["n"]))
    docs = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(lo)), "_h": F.xxhash64("text")})
    wide = hi - lo >= 2**63  # a difference of ids may be no long
    width = min(max(width, 2 if wide else 1), 2**63 - 1)
    cell = F.floor((F.col("_key").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)") if wide else (F.col("_key") - lo) / F.lit(width)).cast("long")

    # the first row of each cell, and which cell comes next
    firsts = docs.withColumn("_cell", cell).groupBy("_cell").agg(F.max(F.struct("_key", "_h")).alias("first")).withColumn("block", F.floor(F.col("_cell") / CELL_ROWS))
    blocks = firsts.groupBy("block").agg(F.max_by("first", "_cell").alias("first"))
    all_blocks = Window.orderBy(F.desc("block"))  # a row for CELL_ROWS * CELL_ROWS documents
    blocks = blocks.select("block", F.coalesce(F.lead("first").over(all_blocks), F.first("first").over(all_blocks)).alias("after"))
    within = Window.partitionBy("block").orderBy(F.desc("_cell"))
    after = firsts.withColumn("lead", F.lead("first").over(within)).join(blocks, "block").select("_cell", F.coalesce("lead", "after").alias("n"))
    after = written(after.select("_cell", F.col("n._key").alias("_key"), F.col("n._h").alias("_h")), "next-cells")  # a row for CELL_ROWS documents
    heads = derive(docs.join(after, ["_key", "_h"]).dropDuplicates(["_cell"]))
    heads = heads.select("_cell", *[F.col(c).alias(f"_head_{c}") for c in payload])
    order = Window.partitionBy("_cell").orderBy(F.desc("_key"), F.desc("_h"))
    rows = derive(docs).withColumn("_cell", cell)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload}).join(heads, "_cell", "left")
    last = F.col(f"next_{payload[0]}").isNull()
    return rows.withColumns({f"next_{c}": F.when(last, F.col(f"_head_{c}")).otherwise(F.col(f"next_{c}")) for c in payload}).drop("_key", "_h", "_cell", *[f"_head_{c}" for c in payload])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Each document beside an edit of it and beside the next document (see with_next).

    In the edit the last third of the code points is the start of the next document's text. Null texts count as empty; repeated rows are
    documents of their own; a single document is its own next; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, lambda d: d.withColumn("sigs", signatures(F.col("text"))), ["text", "sigs"]).withColumn("n_chars", F.length("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - third), F.substr("next_text", F.lit(1), third)))
    return rows.withColumn("edited_sigs", signatures(F.col("edited")))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_likeness(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))
