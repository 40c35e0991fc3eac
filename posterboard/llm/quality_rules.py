"""Quality rules: cross-document line frequency beside per-document counts. Built-in functions only.

A line is trimmed, lower-cased (A-Z) and its digits become 0; its hash is counted over the documents of each host. Documents carry no address, so any column can stand for the host;
the query takes source, the site a document came from. Copies of one text count as one document: what to do with copies is another operator's work, and a line
must not become frequent by them, else every copy of a clean text would lose all its lines. Lines found in more documents than the limit are removed, but for the document with the
smallest id that holds the line, so that one copy of everything stays. Documents which lose too much are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, free_name, table, written

#: A line of a host is frequent if more documents than this hold it: MAX_LINE_SHARE of the host's documents, but MIN_LINE_DOCS at least and MAX_LINE_DOCS at most,
#: so the limit doesn't rise with a large host.
MIN_LINE_DOCS, MAX_LINE_DOCS = 20, 2_000
MAX_LINE_SHARE = 0.02
MIN_KEPT_SHARE = 0.3
MIN_WORDS = 50


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def words_of(text: Column) -> Column:
    """The words of a text: split at single spaces, which is far cheaper than matching each word."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def normal_line(line: Column) -> Column:
    flat = F.translate(line, UPPER + "\t\x0b\x0c\r123456789", LOWER + "    000000000")
    return F.regexp_replace(F.trim(flat), " {2,}", " ")


def document_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to docs (columns of these names are replaced); a null text counts as empty.

    n_repeat_words: the 64-bit hashes of the 3-word windows are sorted, those found twice kept; where there are any,
    the windows' places come back from sorted (hash, place) pairs, and each covers up to three words.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumns({"_t": text, "_w": words_of(text)})
    docs = docs.withColumns({"_n": F.size("_w"), "_lines": _lines(F.col("_t"))})
    # the lambdas see elements only: a column in one would be made again for each element if a caller's filter is pushed down
    pair = F.zip_with(F.expr("slice(_w, 1, greatest(_n - 2, 1))"), F.expr("slice(_w, 2, greatest(_n - 2, 1))"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    window = F.zip_with(pair, F.expr("slice(_w, 3, greatest(_n - 2, 1))"), lambda x, c: F.xxhash64(x.a, x.b, c))
    docs = docs.withColumn("_g", F.when(F.col("_n") > 3, window).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    # sorted (hash, place) pairs; a place counts if a neighbour has the same hash
    pairs = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_s", F.when(F.col("_again"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    # each pair beside those before and after it
    blank = F.expr("array(cast(null as struct<h:bigint,i:int>))")
    trio = F.arrays_zip(F.col("_s").alias("x"), F.concat(blank, F.col("_s")).alias("before"), F.concat(F.expr("slice(_s, 2, greatest(size(_s), 1))"), blank).alias("after"))
    docs = docs.withColumn("_trio", F.when(F.col("_again"), trio))
    hit = F.filter("_trio", lambda t: t.x.h.isNotNull() & (t.x.h.eqNullSafe(t.before.h) | t.x.h.eqNullSafe(t.after.h)))
    docs = docs.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.transform(hit, lambda t: t.x.i))).otherwise(F.array().cast("array<int>")))
    gaps = F.zip_with(F.expr("slice(_p, 2, greatest(size(_p), 1))"), F.expr("slice(_p, 1, greatest(size(_p) - 1, 0))"), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("_p") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    return docs.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }).drop("_t", "_w", "_n", "_lines", "_g", "_again", "_s", "_trio", "_p")


def _text_key() -> Column:
    """A row by its id and text; a null id too."""
    return F.xxhash64("doc_id", "text_hash")


def frequent_lines(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = MAX_LINE_SHARE, max_docs: int = MAX_LINE_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lines, frequent): the line hashes of each document with their words, and those over the host's limit: host, line_hash, n_docs, first.

    docs: doc_id, text (not null), host. n_docs: documents with different texts; first: id and text hash of the one with the smallest id. The lines are a table in the
    shared folder, so texts are cut into lines once. A line that is in no more rows than the least limit goes before any distinct count.
    """
    rows = docs.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), F.explode(_lines(F.col("text"))).alias("line"))
    lines = rows.select("doc_id", "host", "text_hash", F.xxhash64(normal_line(F.col("line"))).alias("line_hash"), F.size(words_of(F.col("line"))).alias("words"))
    lines = written(lines, "lines")
    often = lines.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > min_docs).select("host", "line_hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    per_text = lines.join(often, ["host", "line_hash"]).groupBy("host", "line_hash", "text_hash").agg(first)
    counted = per_text.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") > min_docs)
    texts = docs.select("host", F.xxhash64("text").alias("text_hash")).distinct()
    limits = texts.groupBy("host").agg(F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), F.lit(share) * F.count(F.lit(1)))).alias("limit"))
    frequent = counted.join(limits, "host").where("n_docs > limit").select("host", "line_hash", "n_docs", "first")
    return lines, written(frequent, "frequent-lines")


def _line_key(host: Column, line_hash: Column) -> Column:
    """A line of a host: the same line of another host has its own limit."""
    return F.xxhash64(host, line_hash)


def _judged(docs: DataFrame, host: str) -> DataFrame:
    """What apply_rules returns, with lines_gone: the keys of the document's lines that are removed, null where there are none."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.col(host).cast("string")).alias("host"))
    lines, frequent = frequent_lines(docs)
    gone = lines.join(frequent, ["host", "line_hash"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    # repeated rows have the same lines: of each kind of line their words count once a row
    per_line = gone.groupBy(_text_key().alias("key"), "text_hash", "host", "line_hash").agg(F.sum("words").alias("words"))
    gone = per_line.groupBy("key", "text_hash").agg(F.sum("words").alias("words_gone"), F.collect_list(_line_key(F.col("host"), F.col("line_hash"))).alias("lines_gone"))
    counts = document_counts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").withColumn("key", _text_key())
    out = counts.join(gone, ["key", "text_hash"], "left").withColumn("words_left", F.col("n_words") - F.coalesce("words_gone", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("words_left") >= MIN_WORDS) & (F.col("words_left") >= MIN_KEPT_SHARE * F.col("n_words"))
    return out.withColumn("kept", kept)


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs: doc_id, text and the host column. Returns doc_id, the counts, words_left, base_failed, kept, text_hash.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed,
    and at least MIN_KEPT_SHARE of the words, and MIN_WORDS of them, are left after frequent lines are removed.
    A null or empty text fails; a null host is a host of its own; a null doc_id is a document like any other; other columns are ignored.
    An empty table gives no rows. Repeated rows get the same verdict each.
    """
    return _judged(docs, host).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept", "text_hash")


def text_without(text: Column, host: Column, lines_gone: Column) -> Column:
    """text without the lines whose keys are in lines_gone, the others in their order; the text itself where that is null.

    host: the hash that apply_rules counts by. Lines without a word are never removed.
    """
    key = lambda x: _line_key(host, F.xxhash64(normal_line(x)))
    left = F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(lines_gone, key(x))))
    return F.when(lines_gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that apply_rules keeps, with all their columns, whatever their names; in text, the frequent lines are removed.

    The first document that holds a frequent line keeps it. The words of a text are then those that words_left counts.
    """
    key, gone = free_name(docs, "key"), free_name(docs, "lines_gone")
    # verdicts are a table of their own: a filter on them would be pushed into the counts, and compute them again and again
    good = written(_judged(docs, host).select("key", "kept", "lines_gone"), "verdicts").where("kept")
    good = good.select(F.col("key").alias(key), F.col("lines_gone").alias(gone)).dropDuplicates([key])
    out = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text"))).join(good, key)
    return out.withColumn("text", text_without(F.col("text"), F.xxhash64(F.col(host).cast("string")), F.col(gone))).select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("text_hash")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM g2, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY 1),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
nl AS (SELECT *, regexp_replace(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x09-\x0D]', ' ', 'g')), ' +', ' ', 'g') AS key,
   len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM nl GROUP BY 1),
freq AS (SELECT source, key, min(doc_id) AS first_doc, count(DISTINCT text) AS n FROM nl GROUP BY 1, 2),
lim AS (SELECT source, least(2000.0, greatest(20.0, 0.02 * count(DISTINCT text))) AS m FROM d GROUP BY 1),
bad AS (SELECT f.* FROM freq f JOIN lim l ON f.source IS NOT DISTINCT FROM l.source WHERE f.n > l.m),
gone AS (SELECT nl.doc_id, sum(nl.words)::BIGINT AS n FROM nl JOIN bad b ON nl.source IS NOT DISTINCT FROM b.source AND nl.key = b.key WHERE nl.doc_id <> b.first_doc GROUP BY 1),
c AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
   length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
   coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(w.w) - coalesce(gone.n, 0))::BIGINT AS words_left
 FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT *, (NOT base_failed AND words_left >= 50 AND words_left >= 0.3 * n_words) AS kept FROM f
"""
