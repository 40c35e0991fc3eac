"""SentencePiece (BPE with byte fallback) encoding and decoding through a merge-type prefix table.

For each prefix of a word exactly one token can come last in the prefix's own encoding. An automaton over all pieces gives the
tokens that end at a place; the one that fits is stored: it spans the whole prefix, or the pair of it and the token that is stored
where it starts is compatible (encoding the two together leaves them as they are). Walking back from the end gives the ids.
No text is merged step by step, and a word's cost is in proportion to its matches.

The model's pieces hold the space sign only in front, or are runs of it, so words are encoded one by one and
remembered. Runs of spaces, whose pieces all have the same score, follow from the library's rule to take the leftmost pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SPACE_SIGN = "▁"
#: Words that one Python worker remembers in each of two generations, at most.
CACHE_WORDS = 200_000
CACHE_PAIRS = 300_000
#: Rows that are encoded at a time.
ROWS = 256
_NORMAL, _UNKNOWN_TYPE, _CONTROL, _BYTE = 1, 2, 3, 6


class PieceTable:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with the identity rule and a dummy prefix are supported")
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text = np.empty(len(model.pieces), dtype=object)
        for i, p in enumerate(model.pieces):
            self.text[i] = p.piece.replace(SPACE_SIGN, " ").encode()
            if p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.text[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == _NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == _CONTROL:
                self.text[i] = b""
            elif p.type == _UNKNOWN_TYPE:
                self.text[i] = " ⁇ ".encode()
        self.runs = {len(p) for p in self.ids if not p.strip(SPACE_SIGN)}
        pieces = {p for p in self.ids if not (len(p) > 1 and not p.strip(SPACE_SIGN))}
        if any(SPACE_SIGN in p[1:] for p in pieces):
            raise ValueError("a piece has the space sign inside")
        # rank: when a piece arises by merging; single characters are there from the start
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {p: k for k, p in enumerate(order)} | {p: -1 for p in pieces if len(p) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in pieces:
            if len(p) == 1:
                self.automaton.add_word(p, p)
            elif (last := self._last_merge(p)) is not None:
                self.halves[p] = last
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        outside = "".join(map(re.escape, sorted(p for p in pieces if len(p) == 1)))
        self.unknown = re.compile(f"([^{outside}])")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.old_words: dict[str, list[int]] = {}
        self.run_cache: dict[int, list[int]] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The merge that makes piece out of its characters; None if merging ends otherwise."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                return None
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = ["".join(last)]
        return last

    def compatible(self, a: str, b: str) -> bool:
        """True if encoding a + b gives a, b: no merge across the border comes before those which build a and b.

        Goes back in time: the later of the two tokens is taken apart, and the pair at the border is tested again,
        against merges that came before that moment. The left side is merged first among equals.
        """
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        key, rank, limit, ok = (a, b), self.rank, 1 << 60, True
        while True:
            if rank.get(a + b, 1 << 60) < limit:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _known(self, s: str) -> list[int]:
        """Ids of a string of characters that are all pieces."""
        n = len(s)
        last: list[str | None] = [None] * (n + 1)
        for end, token in self.automaton.iter(s):
            start = end + 1 - len(token)
            if start == 0 or ((before := last[start]) is not None and self.compatible(before, token)):
                last[end + 1] = token
        out = []
        while n:
            out.append(self.ids[last[n]])
            n -= len(last[n])
        return out[::-1]

    def word(self, word: str) -> list[int]:
        """Ids of one word with the space sign before it."""
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.old_words.get(word)
        if found is None:
            found = []
            for part in self.unknown.split(SPACE_SIGN + word):
                if not part:
                    continue
                if len(part) == 1 and part not in self.ids:
                    found += [self.bytes[b] for b in part.encode()]
                else:
                    found += self._known(part)
        if len(self.words) >= CACHE_WORDS:
            self.old_words, self.words = self.words, {}
        if len(word) <= 64:
            self.words[word] = found
        return found

    def spaces(self, k: int) -> list[int]:
        """Ids of k space signs that meet no word: the leftmost pair that makes a piece goes first, again and again."""
        if (found := self.run_cache.get(k)) is None:
            done, left, now = [], k - 1, 1
            while True:
                if done and done[-1] + now in self.runs:
                    now += done.pop()
                elif left and now + 1 in self.runs:
                    now, left = now + 1, left - 1
                elif left:
                    done.append(now)
                    now, left = 1, left - 1
                else:
                    break
            found = self.run_cache[k] = [self.ids[SPACE_SIGN * n] for n in [*done, now]]
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words = text.replace(SPACE_SIGN, " ").split(" ")
        if "" not in words:
            for w in words:
                out += self.word(w)
            return out
        alone, run = self.ids[SPACE_SIGN], 0
        for w in words:
            run += 1
            if w:
                ids = self.word(w)
                if run > 1:
                    out += self.spaces(run) + ids[1:] if ids[0] == alone else self.spaces(run - 1) + ids
                else:
                    out += ids
                run = 0
        return out + self.spaces(run) if run else out

    def decode(self, ids) -> str:
        out = b"".join(self.text[np.asarray(ids, dtype=np.int64)]) if len(ids) else b""
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """One table per model and worker."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encode_documents(docs: DataFrame, model: str, decode: bool = False) -> DataFrame:
    """Adds ids array<int> to docs, which needs text, and decoded, which is made from the ids, if asked for. model: a path that all executors have.

    Whole texts are encoded; a null or empty text has no ids. Other columns pass through, but for ones of these names. Each row is on its own, so
    ties, repeated rows and empty tables are nothing special.
    """
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = piece_table(model)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = [np.array(t.encode(x), dtype=np.int32) for x in part.column("text").to_pylist()]
                columns = [*part.columns, pa.array(ids, type=pa.list_(pa.int32()))]
                if decode:
                    columns.append(pa.array([t.decode(x) for x in ids], type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, model, decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
