"""LM scoring: a Katz back-off model of any order, trigrams by default. Good-Turing discounted counts, and back-off weights that normalise exactly.

    P(w | h) = d(c(h w)) c(h w) / N(h)  if h w was seen,  else  alpha(h) P(w | h'), h' being h without its first word;  P(w) = d(c(w)) c(w) / N, the rest being the unknown word's
    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over seen w)

Where the work is: texts are cut into chunks of about CHUNK_TOKENS tokens, which are tokenised once, into a file each in the shared folder. A chunk asks for the counts
of its distinct words, then of its distinct pairs, then of its distinct triples: n-grams are dealt by their history into ranges, each range's slice goes to the task which holds that
range of the count table, and comes back with the counts over all chunks and with what alpha needs of each history, all of it as whole numbers, so that the discounts, which
only the finished table tells, are applied at the end. What moves are distinct n-grams of chunks as compressed arrays of word numbers, not a row per token. Each level's table is a
Parquet table of slices. How many ranges there are goes by the size of the text, so a range doesn't grow with the corpus. Very frequent histories, a bounded number, have their n-grams
spread over all ranges, and their sums are added up apart.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fresh_path, remove, table, write_fresh, written

ORDER = 3
CHUNK_TOKENS = 1_200_000
#: Ranges of a count table: one for so many characters of text, and so many at least.
RANGE_CHARS = 32_000_000
MIN_RANGES = 128
#: Counting goes through the ranges, and scoring through the chunks, in so many parts: no more than one part of what is asked or answered is in an exchange beside the tables, and what was asked goes once it is answered.
PARTS = 4
#: Counts up to CUT are discounted.
CUT = 5
#: A history with over 1/HOT of all training tokens is very frequent; there are fewer than HOT of them.
HOT = 400
END = np.uint64(0x9AE16A3B2F90404F)
_P = np.uint64(0x9E3779B97F4A7C15)


def _small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes and so on: small numbers compress better."""
    return zstandard.compress(pickle.dumps([(a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in map(np.ascontiguousarray, arrays)], protocol=5), 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, data in pickle.loads(zstandard.decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1))
    return out


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and of one end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def vocabulary(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, place): the distinct hashes, sorted, and each token's place among them. Only the distinct ones are sorted."""
    number, words = pd.factorize(found)
    order = np.argsort(words)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return words[order], place[number]


@dataclass(frozen=True)
class Level:
    """What the whole training text says of one level: tokens, types, and the discount of each count."""

    total: int
    types: int
    discount: np.ndarray  # by count, 0 to CUT + 1; the last for all that are larger

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return self.discount[np.minimum(counts, CUT + 1).astype(np.int64)] * counts

    def mass(self, by_count: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Discounted count of types of which by_count[:, r - 1] were seen r times, and the others beyond times together."""
        return by_count @ (self.discount[1 : CUT + 1] * np.arange(1, CUT + 1)) + beyond

    @staticmethod
    def of(total: int, types: int, n: list[int]) -> Level:
        """n: how many types were seen once, twice, ... CUT + 1 times.

        Katz's discounts need counts of counts that fall smoothly. Where copies in the text upset that, they are taken from the line through
        the logarithms (as in simple Good-Turing); a corpus too small for that has half a count taken off each.
        """
        r = np.arange(1, CUT + 1)

        def katz(n: np.ndarray) -> np.ndarray:
            last = (CUT + 1) * n[CUT] / n[0]
            return ((r + 1) * n[1:] / (r * n[:CUT]) - last) / (1 - last) if last < 1 else np.zeros(CUT)

        fits = lambda d: bool(((d > 0) & (d < 1)).all())
        d = np.zeros(CUT)
        if all(n):
            d = katz(np.array(n, dtype=np.float64))
            if not fits(d):
                every = np.log(np.arange(1, CUT + 2))
                d = katz(np.exp(np.polyval(np.polyfit(every, np.log(n), 1), every)))
        if not fits(d):
            d = (r - 0.5) / r
        return Level(total, types, np.concatenate([[0.0], d, [1.0]]))


@dataclass(frozen=True)
class Unigrams:
    level: Level
    seen: float = 0.0  # sum of discounted counts

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these training counts; 0 is the unknown word."""
        level = self.level
        if not level.total:
            return np.ones(len(counts))
        return np.where(counts > 0, level.discounted(counts) / self.whole, self.unknown)

    @property
    def whole(self) -> float:
        """The denominator: one more where no count is discounted, so that something is left."""
        return self.level.total + (1 if self.seen >= self.level.total else 0)

    @property
    def unknown(self) -> float:
        return 1 - self.seen / self.whole if self.level.total else 1.0


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _chunks(docs: DataFrame, folder: str, ranges: int) -> DataFrame:
    """docs: doc_id, text, train. Writes the chunks' files; returns range, chunk, blob (words, training counts)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        chunk = TaskContext.get().partitionId() << 24
        ids, train, found, size = [], [], [], 0

        def rows() -> pd.DataFrame:
            words, local = vocabulary(np.concatenate(found))
            lengths, flags = np.array([len(f) for f in found]), np.array(train, dtype=np.uint8)
            often = np.argsort(-np.bincount(local), kind="stable")  # frequent words have small numbers in the file
            rank = np.empty_like(often)
            rank[often] = np.arange(len(often))
            temporary = f"{root}/_{chunk}-{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary, compression=None) as f:
                f.write(pickle.dumps((ids, _pack(_small(lengths), flags, words[often], _small(rank[local])))))
            fs.move(temporary, f"{root}/{chunk}")  # the same name and content in any attempt
            counts = np.bincount(local[np.repeat(flags, lengths) > 0], minlength=len(words))
            cut = _cut(words, ranges)
            return pd.DataFrame([(k, chunk, _pack(words[a:b], _small(counts[a:b]))) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b], columns=["range", "chunk", "blob"])

        for pdf in batches:
            for doc_id, text, is_train in zip(pdf["doc_id"], pdf["text"], pdf["train"], strict=True):
                t = tokens(text)
                ids.append(doc_id)
                train.append(bool(is_train))
                found.append(t)
                size += len(t)
                if size >= CHUNK_TOKENS:
                    yield rows()
                    chunk, ids, train, found, size = chunk + 1, [], [], [], 0
        if size:
            yield rows()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "train")
    return rows.mapInPandas(make, "range int, chunk long, blob binary")


def _cut(words: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins in the sorted words, and the end."""
    step = (1 << 64) // ranges
    return np.concatenate([np.searchsorted(words, np.array([k * step for k in range(ranges)], dtype=np.uint64)), [len(words)]])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, where, inverse): the distinct keys in order, a place where each stands (any), and each key's place among them. The sort needn't be stable, which is twice as fast."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def _first_seen(values: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """The distinct values (places in scratch) as they first come; no sort."""
    place = np.arange(len(values))
    scratch[values[::-1]] = place[::-1]  # the first place is written last
    return values[scratch[values] == place]


@dataclass
class Grams:
    """The distinct n-grams of a chunk at one level, sorted by range, suffix and first word; histories and suffixes are places in the level below."""

    hist: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    first: np.ndarray
    part: np.ndarray
    count: np.ndarray  # in this chunk's training texts


def _mixed(key: np.ndarray) -> np.ndarray:
    key = key.astype(np.uint64) * _P
    return key ^ (key >> np.uint64(31))


class Chunk:
    """A chunk's file, and what it asks of the count tables, level by level."""

    def __init__(self, folder: str, chunk: int, ranges: int, total_tokens: int):
        fs, root = _filesystem(folder)
        with fs.open_input_file(f"{root}/{chunk}") as f:
            self.doc_ids, blob = pickle.loads(f.read())
        lengths, train, words, local = _unpack(blob)
        order = np.argsort(words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.words, self.local = words[order], place[local].astype(np.int32)  # places in 32 bits: what is gathered from at random should be small
        self.ranges, self.total_tokens, self.lengths, self.train = ranges, total_tokens, lengths.astype(np.int64), train > 0
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.place = np.arange(len(self.local)) - np.repeat(self.starts, self.lengths)  # in its text
        self.in_train = np.repeat(self.train, self.lengths)
        self.levels: dict[int, Grams] = {}
        self.at = {1: self.local}  # of each token, the n-gram that it ends; -1 where the text hasn't begun early enough
        self.total: dict[int, np.ndarray] = {}
        self.first = {1: np.arange(len(self.words))}  # of each n-gram, its first word

    def answer_words(self, blobs: list[list[np.ndarray]], of_range: list[int]) -> None:
        """Global counts and numbers of the words; frequent words have small numbers."""
        self.total[1] = np.concatenate([b[0] for b in blobs]).astype(np.int64)
        self.number = np.concatenate([b[1].astype(np.int64) * self.ranges + k for b, k in zip(blobs, of_range, strict=True)])
        self.key = _mixed(self.number)

    def parts(self, k: int, at: np.ndarray, hist: np.ndarray) -> np.ndarray:
        """The ranges of the n-grams of level k that end at these tokens.

        The range goes by the history's last word; where that has more than a small part of a range, by the words before it too; and for a very frequent history by the word that follows.
        """
        last = self.local[at - 1]
        key = self.key[last]
        if k > 2:
            spread = np.flatnonzero((self.total[1] > self.total_tokens / (4 * self.ranges))[last])
            for back in range(k - 1, 1, -1):
                key[spread] = key[spread] * _P + self.key[self.local[at[spread] - back]]
        hot = np.flatnonzero(self.hot[hist])
        key[hot] = key[hot] * _P + self.key[self.local[at[hot]]]
        return (key ^ (key >> np.uint64(29))) % np.uint64(self.ranges)

    def grams(self, k: int, hot_count: float) -> Grams:
        """Makes level k from the level below, whose totals are known. One sort puts the n-grams in order: the range is made for each token, in the order of the text."""
        below, at = self.at[k - 1], np.flatnonzero(self.place >= k - 1)
        suffix, hist, first = below[at], below[at - 1], self.local[at - (k - 1)]  # of each token's n-gram
        self.hot = self.total[k - 1] > hot_count
        low = (len(self.words) - 1).bit_length()
        keys, bits = (suffix.astype(np.int64) << low) | first, (len(self.total[k - 1]) - 1).bit_length() + low
        if bits + (self.ranges - 1).bit_length() > 64:
            values, _, keys = _distinct(keys)
            bits = (len(values) - 1).bit_length()
        keys, where, inverse = _distinct((self.parts(k, at, hist) << np.uint64(bits)) | keys.astype(np.uint64))
        self.at[k] = np.full(len(self.local), -1, dtype=np.int32)
        self.at[k][at] = inverse
        count = np.bincount(inverse[self.in_train[at]], minlength=len(keys))
        self.first[k] = first[where]
        self.levels[k] = Grams(hist[where], self.local[at[where]], suffix[where], self.first[k], (keys >> np.uint64(bits)).astype(np.int64), count)
        return self.levels[k]

    def spell(self, k: int, which: np.ndarray) -> list[np.ndarray]:
        """The word numbers of these n-grams, a column per word."""
        if k == 1:
            return [self.number[which]]
        level = self.levels[k]
        return [self.number[level.first[which]], *self.spell(k - 1, level.suffix[which])]

    def slices(self, k: int) -> Iterator[tuple[int, slice]]:
        cut = np.searchsorted(self.levels[k].part, np.arange(self.ranges + 1))
        for r in range(self.ranges):
            if cut[r] < cut[r + 1]:
                yield r, slice(cut[r], cut[r + 1])


def _sums(group: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    return np.bincount(group, weights=value.astype(np.float64), minlength=m).astype(np.int64)


def _tally(group: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    """Of each of m groups, how many counts are 1, 2, ... CUT: a row per group."""
    low = count <= CUT
    return np.bincount(group[low] * CUT + count[low] - 1, minlength=m * CUT).reshape(m, CUT)


@dataclass
class Histories:
    """Of each history of a level: its tokens N, how many types follow it once, twice, ... CUT times; and the same of these types' counts one level below."""

    total: np.ndarray
    n: np.ndarray
    below: np.ndarray
    below_beyond: np.ndarray

    @staticmethod
    def empty(m: int) -> Histories:
        return Histories(np.zeros(m, dtype=np.int64), np.zeros((m, CUT), dtype=np.int64), np.zeros((m, CUT), dtype=np.int64), np.zeros(m, dtype=np.int64))

    def put(self, at: np.ndarray, columns: list[np.ndarray]) -> None:
        """columns: tokens of types seen more than CUT times, n, below, below_beyond. Rows without tokens say nothing and are left out."""
        told = np.flatnonzero(reduce(np.logical_or, columns[: CUT + 1]))
        at, columns = at[told], [c[told] for c in columns]
        n = np.stack(columns[1 : CUT + 1], axis=1).astype(np.int64)
        self.n[at], self.below[at] = n, np.stack(columns[CUT + 1 : -1], axis=1)
        self.total[at], self.below_beyond[at] = n @ ONCE + columns[0].astype(np.int64), columns[-1]

    def fill_complete(self, hist: np.ndarray, count: np.ndarray, lower: np.ndarray) -> None:
        """hist, count, lower: of seen n-grams. Of a history for which the answer says nothing they are all that follows it (or nothing does), so they say it."""
        untold = ~(self.total > 0)[hist]
        hist, count, lower = hist[untold], count[untold], lower[untold]
        m = len(self.total)
        self.total += _sums(hist, count, m)
        self.n += _tally(hist, count, m)
        self.below += _tally(hist, lower, m)
        self.below_beyond += _sums(hist[lower > CUT], lower[lower > CUT], m)


#: Numbers of a history in an answer.
FACTS = 2 * CUT + 2
ONCE = np.arange(1, CUT + 1)


def codes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(code, where): which distinct row each row is, from 0, and a place where each distinct row stands."""
    code, top = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if top * wide >= 1 << 63:
            code = _distinct(code)[2]
            top = len(code) + 1
        if top * wide >= 1 << 63:
            c = _distinct(c)[2]
            wide = len(c) + 1
        code, top = code * wide + c, top * wide
    _, where, code = _distinct(code)
    return code, where


#: blob: the counts of a slice's n-grams; histories: what was found of its histories, which only scoring asks for.
ANSWER = "level int, range int, chunk long, blob binary, histories binary, facts array<long>"


def _row(level: int, range_: int, chunk: int, blob: bytes, histories: bytes | None = None, facts=None) -> tuple:
    return level, range_, chunk, blob, histories, facts


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["level", "range", "chunk", "blob", "histories", "facts"])


def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    asked = [_unpack(b) for b in pdf["blob"]]
    words, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked]).astype(np.float64)).astype(np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    rows, at = [], 0
    for k, chunk, (mine, _) in zip(pdf["range"], pdf["chunk"], asked, strict=True):
        which = inverse[at : at + len(mine)]
        rows.append(_row(1, k, chunk, _pack(_small(counts[which]), _small(rank[which]))))
        at += len(mine)
    rows.append(_row(1, -1, -1, b"", None, [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, CUT + 2))]))
    return _frame(rows)


def count_grams(k: int):
    return lambda pdf: _count_grams(pdf, k)


def _count_grams(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The counts of one range of level k. A slice holds its suffixes' words, counts one level below and numbers of n-grams; then each n-gram's first word and count, and which are spread."""
    parts = [[a.astype(np.int64) for a in _unpack(blob)] for blob in pdf["blob"]]
    joined = [np.concatenate([p[i] for p in parts]) for i in range(k + 4)]
    spelled, lower, runs, first, count, spread = joined[: k - 1], *joined[k - 1 :]
    suffix, _ = codes(spelled)
    hist_words = spelled[:-1]
    of_suffix = np.repeat(np.arange(len(runs)), runs)
    h, h_first = codes([first, *(c[of_suffix] for c in hist_words)])
    m = len(h_first)
    hot = np.unique(h[spread > 0])
    wide = int(first.max(initial=0)) + 1
    if (int(suffix.max(initial=0)) + 1) * wide >= 1 << 63:
        values, _, first_dense = _distinct(first)
        wide = len(values)
    else:
        first_dense = first
    _, kind_first, kind = _distinct(suffix[of_suffix] * wide + first_dense)
    counts = np.bincount(kind, weights=count.astype(np.float64)).astype(np.int64)
    seen = counts > 0
    th, tlower, c = h[kind_first][seen], lower[of_suffix[kind_first]][seen], counts[seen]
    n_types = np.bincount(th, minlength=m)
    facts = [*map(_small, (_sums(th[c > CUT], c[c > CUT], m), *_tally(th, c, m).T, *_tally(th, tlower, m).T, _sums(th[tlower > CUT], tlower[tlower > CUT], m)))]
    of_gram, rows, b, own, scratch = _small(counts)[kind], [], 0, np.zeros(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for r, chunk, part in zip(pdf["range"], pdf["chunk"], parts, strict=True):
        mine = slice(b, b + len(part[k + 1]))
        at = _first_seen(h[mine], scratch)  # histories as they first come in the slice
        # a slice that holds all that follows a history knows all of this by itself (an n-gram is in a slice once)
        seen_here = h[mine][of_gram[mine] > 0]
        np.add.at(own, seen_here, 1)
        asks = own[at] < n_types[at]
        own[seen_here] = 0
        rows.append(_row(k, r, chunk, _pack(_small(of_gram[mine])), _pack(*[_small(f[at] * asks) for f in facts])))
        b = mine.stop
    rows.append(_row(k, -1, -1, b"", None, [int(c.sum()), len(c), *(int((c == r).sum()) for r in range(1, CUT + 2))]))
    for i in hot:
        name = [first[h_first[i]], *(w[of_suffix[h_first[i]]] for w in hist_words)]
        rows.append(_row(k, -2, -2, b"", None, [*map(int, name), *(int(f[i]) for f in facts)]))
    return _frame(rows)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs: doc_id, text, train (learn from this row?). Returns doc_id, train, n_tokens, n_known, train_tokens, base_score, score: a row per row.

    Scores are log10 probabilities, of an add-one unigram model (base) and of the back-off model over n-grams up to order. A null or empty text is one end token. Repeated rows
    are counted and scored each; a null train is no training. Without training rows every token is the unknown word, with probability 1. A long text stays whole in its chunk. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(MIN_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    folder = fresh_path(spark, "chunks")

    def kept(found: DataFrame, k: int) -> DataFrame:
        part = F.when(F.col("chunk") >= 0, F.pmod(F.xxhash64("chunk"), F.lit(PARTS))).otherwise(-1).cast("int")
        return written(found.withColumn("part", part), f"counts-{k}", "part")

    answers = {1: kept(_chunks(docs, folder, ranges).groupBy("range").applyInPandas(count_words, ANSWER), 1)}

    def facts_of(k: int) -> Level:
        sums = answers[k].where("chunk = -1").agg(*[F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(CUT + 3)]).first()
        total, types, *n_r = [int(x or 0) for x in sums]
        numbers[k] = n_r
        return Level.of(total, types, n_r)

    numbers: dict[int, list[int]] = {}
    levels = {1: facts_of(1)}
    total_tokens = levels[1].total
    by_count = np.array([numbers[1][:CUT]])
    unigrams = Unigrams(levels[1], float(levels[1].mass(by_count, total_tokens - by_count @ ONCE)[0]))
    hot_count = max(total_tokens / HOT, 50)
    hot: dict[int, dict[tuple, list]] = {}

    def opened(pdf: pd.DataFrame, upto: int) -> Chunk:
        """The chunk with its levels below upto and their totals."""
        chunk = Chunk(folder, int(pdf["chunk"].iloc[0]), ranges, total_tokens)
        pdf = pdf.sort_values(["level", "range"])
        got = {k: [_unpack(b) for b in g["blob"]] for k, g in pdf.groupby("level")}
        chunk.answer_words(got[1], list(pdf.loc[pdf["level"] == 1, "range"]))
        for k in range(2, upto):
            chunk.grams(k, hot_count)
            chunk.total[k] = np.concatenate([g[0] for g in got.get(k, [])] or [np.zeros(0)]).astype(np.int64)
        return chunk

    def asking(k: int):
        def ask(pdf: pd.DataFrame) -> pd.DataFrame:
            chunk = opened(pdf, k)
            level, rows = chunk.grams(k, hot_count), []
            lower = chunk.total[k - 1]
            for r, s in chunk.slices(k):
                new = np.flatnonzero(np.diff(level.suffix[s], prepend=-1))
                suffix, runs = level.suffix[s][new], np.diff(np.append(new, s.stop - s.start))
                mine = [*chunk.spell(k - 1, suffix), lower[suffix], runs, chunk.number[level.first[s]], level.count[s], chunk.hot[level.hist[s]].astype(np.uint8)]
                rows.append((r, int(pdf["chunk"].iloc[0]), _pack(*map(_small, mine))))
            return pd.DataFrame(rows, columns=["range", "chunk", "blob"])

        return ask

    def known(upto: int, *more: str, parts: list[int] = [*range(PARTS)]) -> DataFrame:
        """The answers of the levels below upto to the chunks of some parts, by chunk."""
        return reduce(DataFrame.unionByName, [answers[k].where(F.col("part").isin(parts)).select("level", "range", "chunk", "blob", *more) for k in range(1, upto)]).groupBy("chunk")

    for k in range(2, order + 1):
        asked = known(k).applyInPandas(asking(k), "range int, chunk long, blob binary").withColumn("part", F.pmod(F.xxhash64("range"), F.lit(PARTS)).cast("int"))
        path, found = write_fresh(asked, f"asked-{k}", "part"), []
        for i in range(PARTS):
            mine = spark.read.schema(asked.schema).parquet(path).where(F.col("part") == i)
            found.append(kept(mine.groupBy("range").applyInPandas(count_grams(k), ANSWER), k))
            remove(spark, f"{path}/part={i}")
        answers[k] = reduce(DataFrame.unionByName, found)
        levels[k] = facts_of(k)
        sums = answers[k].where("chunk = -2").groupBy(F.slice("facts", 1, k - 1).alias("h")).agg(*[F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(k - 1, k - 1 + FACTS)])
        hot[k] = {tuple(x["h"]): list(x)[1:] for x in sums.collect()}  # fewer than HOT rows

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = opened(pdf, order + 1)
        p = unigrams.probability(chunk.total[1])
        token_p, whole_below, suffix_below = p[chunk.local], np.full(1, unigrams.whole), None
        for k in range(2, order + 1):
            level, histories, m = chunk.levels[k], Histories.empty(len(chunk.total[k - 1])), levels[k]
            scratch = np.empty(len(chunk.total[k - 1]), dtype=np.int64)
            for (_, s), blob in zip(chunk.slices(k), pdf.loc[pdf["level"] == k].sort_values("range")["histories"], strict=True):
                histories.put(_first_seen(level.hist[s], scratch), _unpack(blob))
            spread = np.flatnonzero(chunk.total[k - 1] > hot_count)
            for i, name in zip(spread, zip(*chunk.spell(k - 1, spread), strict=True), strict=True):
                if (found := hot[k].get(tuple(map(int, name)))) is not None:
                    histories.put(np.array([i]), [np.array([x]) for x in found])
            c = chunk.total[k]
            histories.fill_complete(level.hist[c > 0], c[c > 0], chunk.total[k - 1][level.suffix[c > 0]])
            total = histories.total
            mass = m.mass(histories.n, total - histories.n @ ONCE)
            whole = np.maximum(total + (mass >= total), 1)
            # what the types that follow a history have one level below, where the history is a word shorter
            seen_below = levels[k - 1].mass(histories.below, histories.below_beyond) / (whole_below[suffix_below] if suffix_below is not None else whole_below)
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.where(total > 0, (1 - mass / whole) / (1 - seen_below), 1.0)
            p = np.where(c > 0, m.discounted(c) / whole[level.hist], alpha[level.hist] * p[level.suffix])
            there = chunk.at[k] >= 0
            token_p[there] = p[chunk.at[k][there]]
            whole_below, suffix_below = whole, level.suffix
        counts = chunk.total[1]
        by_text = lambda x: np.add.reduceat(x, chunk.starts)
        return pd.DataFrame({
            "doc_id": chunk.doc_ids, "train": chunk.train, "n_tokens": chunk.lengths, "n_known": by_text((counts[chunk.local] > 0).astype(np.int64)), "train_tokens": total_tokens,
            "base_score": by_text(np.log10((counts + 1) / (total_tokens + levels[1].types + 1))[chunk.local]), "score": by_text(np.log10(token_p)),
        })

    scores = "doc_id string, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = [written(known(order + 1, "histories", parts=[i]).applyInPandas(score, scores), f"scores-{i}") for i in range(PARTS)]
    return reduce(DataFrame.unionByName, out).withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
