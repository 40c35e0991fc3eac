"""Token counts of whole texts, exactly as a tokenizer file gives them, with huge documents shared out.

A huge document is cut into chunks that overlap. Each chunk is encoded by itself, with offsets, in whatever task it falls to; two neighbours are spliced in their overlap at the first place where
both start a token and which is proven stable: the pre-tokenizer always cuts there, whatever stands before and after (see stable). Counts between such places add up to the document's. Where an overlap
has no such place it is widened over the whole of the next chunk, again and again until a place is found or the text ends: these chunks become one and are encoded anew.

In other documents white space is a stable place too, so words are counted one by one, and frequent words are remembered.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, table, written

#: Code points of a chunk, and of its overlap with the next; a document of more than one chunk is huge.
CHUNK, OVERLAP = 65_536, 1_024
LIMIT = 2_048
#: Words that one Python worker remembers in each of two generations, and the longest of them.
CACHE_WORDS, WORD_BYTES = 150_000, 48
#: Words that are encoded at a time.
WORDS_AT_ONCE = 20_000

_SPACE = " \t\n\x0b\x0c\r"
#: Letters that no normalisation joins with a neighbour, and signs that are never part of a contraction, a special token or a composed character.
_LETTER = re.compile("[A-Za-z一-鿿]")
_SIGN = re.compile("[!\"#$%&()*+,./:;=?@\\[\\]^_`{}~。，！？：；（）、-]")
_DIGIT = re.compile("[0-9]")


class Counter:
    """Counts by one tokenizer file of the tokenizers library. stable and words hold for the kind of pre-tokenizer that __init__ looks for; with any other, texts are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.parted = self._parts_at_spaces(spec)
        self.words: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    @staticmethod
    def _parts_at_spaces(spec: dict) -> bool:
        """True if tokens never hold or look across white space: matches of letters, single numbers, or signs, the rest removed; special strings without white space; local normalisation."""
        norm = spec.get("normalizer") or {}
        norms = norm.get("normalizers", [norm] if norm else [])
        local = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in norms)
        pre = spec.get("pre_tokenizer") or {}
        pres = pre.get("pretokenizers", [pre] if pre else [])
        split = bool(pres) and pres[0].get("type") == "Split" and pres[0].get("behavior") == "Removed" and pres[0].get("invert") is True
        split = split and pres[0]["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pres[1:])
        added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|") and t["content"].endswith("|>") and t["content"][2:-2].isalpha() for t in spec.get("added_tokens", []))
        return local and split and rest and added and not (spec["model"].get("dropout") or 0)

    def stable(self, text: str, at: int) -> bool:
        """True if the tokens of text are those of text[:at] and of text[at:], whatever stands further off.

        Beside white space every pattern ends, no special string goes on, and nothing is composed. Between a letter and a sign, or beside a digit, the pattern's classes change: contractions
        need an apostrophe, special strings a bracket or a bar, and composed characters a mark, none of which are among these characters.
        """
        if not self.parted or not 0 < at < len(text):
            return False
        a, b = text[at - 1], text[at]
        if a in _SPACE or b in _SPACE:
            return True
        letter, sign, digit = ((bool(x.match(a)), bool(x.match(b))) for x in (_LETTER, _SIGN, _DIGIT))
        known = (letter[0] or sign[0] or digit[0]) and (letter[1] or sign[1] or digit[1])
        return bool(known and (any(digit) or letter[0] != letter[1]))

    def starts(self, text: str) -> list[int]:
        """The offset of each token's first code point, ascending."""
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str | None) -> int:
        """The tokens of one text, word by word."""
        if not text:
            return 0
        if not self.parted:
            return self.whole(text)
        total, new = 0, []
        for w in text.encode().split():  # bytes are split at ASCII white space only
            if (n := self.words.get(w)) is None and (n := self.old.get(w)) is None:
                new.append(w)
            else:
                total += n
        for k in range(0, len(new), WORDS_AT_ONCE):
            total += self._learn(new[k : k + WORDS_AT_ONCE])
        return total

    def _learn(self, words: list[bytes]) -> int:
        distinct = list(dict.fromkeys(words))
        sizes = [len(e) for e in self.tokenizer.encode_batch([w.decode() for w in distinct], add_special_tokens=False)]
        known = dict(zip(distinct, sizes, strict=True))
        if len(self.words) + len(known) > CACHE_WORDS:
            self.old, self.words = self.words, {}
        self.words.update((w, n) for w, n in known.items() if len(w) <= WORD_BYTES)
        return sum(known[w] for w in words)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each file and worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def word_count(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for part in parts:
            yield pd.Series([c.count(x) for x in part], dtype="int64")

    return run(text)


CHUNKS = "key string, k long, start long, text string"
#: What is known of an encoded chunk: where its tokens start in the overlap on its left and right, as places of the document, with the number of its tokens before.
ENDS = "key string, k long, tokens long, left array<struct<at:long,n:long>>, right array<struct<at:long,n:long>>"


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """docs: key, text. The overlapping chunks of each text; of equal keys one copy's, as they are dealt out by key and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                text = text.as_py()
                for k, start in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pydict({"key": [key.as_py()], "k": [k], "start": [start], "text": [text[start : start + chunk + overlap]]})

    return docs.select("key", "text").mapInArrow(run, CHUNKS).dropDuplicates(["key", "k"])


def ends(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Encodes each chunk, and keeps its number of tokens and the stable starts in its overlaps."""

    def places(c: Counter, text: str, starts: list[int], base: int, lo: int, hi: int) -> list[dict]:
        found = []
        for i in range(bisect_left(starts, lo), bisect_left(starts, hi)):
            if (i == 0 or starts[i] != starts[i - 1]) and c.stable(text, starts[i]):
                found.append({"at": base + starts[i], "n": i})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for row in range(batch.num_rows):
                key, k, start, text = (batch.column(x)[row].as_py() for x in ("key", "k", "start", "text"))
                starts = c.starts(text)
                out = {"key": [key], "k": [k], "tokens": [len(starts)], "left": [places(c, text, starts, start, 0, overlap) if k else []], "right": [places(c, text, starts, start, chunk, len(text))]}
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    place = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("key", pa.string()), ("k", pa.int64()), ("tokens", pa.int64()), ("left", place), ("right", place)])
    return chunks.mapInArrow(run, ENDS)


def seams(found: DataFrame) -> DataFrame:
    """Beside each chunk the splice with the one before it: at (null where there is none) and the tokens before it in this chunk (n_left) and in the one before (n_before)."""
    before = found.select("key", (F.col("k") + 1).alias("k"), F.col("right").alias("_right"))
    rows = found.join(before, ["key", "k"], "left")
    theirs = F.transform("_right", lambda x: x["at"])
    common = F.filter("left", lambda x: F.array_contains(theirs, x["at"]))
    first = F.try_element_at(common, F.lit(1))
    rows = rows.withColumn("_first", first)
    mine = F.try_element_at(F.filter("_right", lambda x: x["at"] == F.col("_first.at")), F.lit(1))
    return rows.select("key", "k", "tokens", F.col("_first.at").alias("at"), F.col("_first.n").alias("n_left"), mine["n"].alias("n_before"))


def huge_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs: key, text; equal keys stand for equal texts. Returns key, n_tokens.

    A run is the chunks between two splices, mostly one chunk; a run of several is a text without a stable place in its overlaps, and is encoded as one.
    """
    chunks = written(cut(docs, chunk, overlap), "chunks")
    spliced = seams(ends(chunks, path, chunk, overlap))
    within = Window.partitionBy("key").orderBy("k")  # a document's own chunks
    rows = spliced.withColumn("run", F.sum(F.when((F.col("k") > 0) & F.col("at").isNull(), 0).otherwise(1)).over(within))
    rows = rows.withColumns({"next_at": F.lead("at").over(within), "n_out": F.lead("n_before").over(within)})
    rows = written(rows.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("key", "run")) == 1), "seams")
    single = rows.where("alone").select("key", (F.coalesce("n_out", "tokens") - F.coalesce("n_left", F.lit(0))).alias("n"))
    # the texts of a run, put together again between its own two splices
    joined = rows.where("NOT alone").join(chunks, ["key", "k"])
    runs = joined.groupBy("key", "run").agg(
        F.max("at").alias("from"), F.max_by("next_at", "k").alias("to"), F.min("start").alias("base"),
        F.array_sort(F.collect_list(F.struct("k", F.substr("text", F.lit(1), F.lit(chunk)).alias("own"), "text"))).alias("parts"),
    )
    last = F.element_at("parts", F.size("parts"))
    own = F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: p["own"])
    text = F.array_join(F.concat(own, F.array(last["text"])), "")
    lo = F.coalesce(F.col("from") - F.col("base"), F.lit(0))
    widened = runs.select("key", F.substr(text, (lo + 1).cast("int"), F.coalesce((F.col("to") - F.col("base") - lo).cast("int"), F.lit(2**31 - 1))).alias("text"))
    counted = widened.select("key", _whole_count(F.col("text"), path).alias("n"))
    return single.unionByName(counted).groupBy("key").agg(F.sum("n").alias("n_tokens"))


def _whole_count(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for part in parts:
            yield pd.Series([c.whole(x) for x in part], dtype="int64")

    return run(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit to docs. path: a tokenizers file that all executors have; special strings in a text count as that library takes them by default.

    Null and empty texts have 0 of both. Texts are encoded whole, whatever their length; equal huge texts are encoded once. Columns of these names are replaced, others pass through; ids, ties
    and repeated rows mean nothing here; an empty table gives no rows.
    """
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk")
    docs = docs.drop(*[c for c in ("n_bytes", "n_tokens", "over_limit") if c != text])
    body = F.coalesce(F.col(text), F.lit(""))
    key = free_name(docs, "_key")
    huge = docs.where(F.length(body) > chunk).withColumn(key, F.sha2(body, 256))
    counts = huge_counts(huge.select(F.col(key).alias("key"), body.alias("text")), path, chunk, overlap).withColumnRenamed("key", key)
    short = docs.where(F.length(body) <= chunk).withColumn("n_tokens", word_count(body, path))
    rows = short.unionByName(huge.join(counts, key).drop(key))
    return rows.withColumns({"n_bytes": F.octet_length(body).cast("long"), "over_limit": F.col("n_tokens") > limit})


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
