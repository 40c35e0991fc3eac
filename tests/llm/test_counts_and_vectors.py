"""Token counts against the library, vector codes and hard negatives against plain loops, with the awkward cases."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from posterboard.llm import hard_negatives, queries, token_counts, vector_codes
from posterboard.llm.vectors import integer_vectors, products

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def odd_texts():
    rng = random.Random(7)
    bits = ["the", "Tournament", "don't", "we'RE", "'s", "'", "''ve", "é", "é", "́", "İ", "ß", "漢字テスト", "，", "。", "ΑΣ", "각", "1234", "٣", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "|", "<", ">", "\x1c", "\x85", "　", "‍", "👩‍🚀", "...", "a-b", "_", "-", "﻿", "\x00"]
    out = []
    for n in (3, 40, 300, 900):
        for space in (" ", "", "\n\t", "　"):
            for _ in range(3):
                out.append("".join(rng.choice(bits) + (space if rng.random() < 0.6 else "") for _ in range(n)))
    return out


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 40), (50, 49)])
def test_token_counts(spark, awkward, nothing, chunk, overlap):
    texts = [*odd_texts(), "x" * 1000, "漢" * 700, "ab12" * 300, "'" * 500, "word " * 200, "a" * 90 + " " + "b" * 300 + " " + "c" * 10, "<|endoftext|>" * 60, " " * 400]
    docs = awkward.select("doc_id", "text", "n", "ids").unionByName(spark.createDataFrame([(k, t, -1, -1) for k, t in enumerate(texts)], "doc_id long, text string, n int, ids int"))
    docs = docs.unionByName(docs.where("length(text) > 500"))  # equal huge texts
    got = token_counts.count_tokens(docs, PATH, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "text", "n", "ids", "n_tokens", "n_bytes", "over_limit"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = by_library(r.text)
        assert (r.n_tokens, r.n_bytes, r.over_limit, r.n) == (want, len((r.text or "").encode()), want > 2048, -1), r.text
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_stable_places_are_stable():
    c = token_counts.Counter(PATH)
    assert c.parted
    for text in odd_texts():
        whole = by_library(text)
        for at in range(1, len(text), 7):
            if c.stable(text, at):
                assert by_library(text[:at]) + by_library(text[at:]) == whole, (text[max(0, at - 5) : at], text[at : at + 5])


def test_widened_overlaps(spark):
    """Texts without a stable place in their overlaps become runs of chunks; others don't."""
    plain, solid = "some words here " * 50, "start " + "é" * 400 + " end of it " * 20
    docs = spark.createDataFrame([("p", plain), ("s", solid)], "key string, text string")
    found = token_counts.seams(token_counts.ends(token_counts.cut(docs, 100, 20), PATH, 100, 20)).where("k > 0")
    spliced = {r.key: r.n for r in found.groupBy("key").agg(F.count_if(F.col("at").isNull()).alias("n")).collect()}
    assert spliced["p"] == 0 and spliced["s"] >= 3
    assert {r.key: r.n_tokens for r in token_counts.huge_counts(docs, PATH, 100, 20).collect()} == {"p": by_library(plain), "s": by_library(solid)}


VECTORS = "vec_id long, embedding array<float>, label int, code int, score int, text string"


def vectors(spark, n=160, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.4 * rng.normal(size=dim)], int(rng.integers(0, 4)), -1, -1, "x" * 10_000 if i == 3 else "") for i in range(n)]
    rows += [(n + k, rows[7][1], 1, -1, -1, None) for k in range(60)]  # copies of one vector
    odd = [(900, None, 1), (901, [1.0] * (dim - 1) + [None], 1), (902, [math.nan] * dim, 1), (903, [math.inf] + [0.0] * (dim - 1), 2), (904, [-math.inf] * dim, None), (905, rows[1][1], None), (None, rows[2][1], 2), (906, [0.5, -0.5], 2), (907, [], 1)]
    return spark.createDataFrame([*rows, *[(i, v, label, -1, -1, "") for i, v, label in odd]], VECTORS)


def plain_integers(df, scale, width):
    kept = [r for r in df.collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    return [(r.vec_id, r.label, [math.floor(scale * x) for x in r.embedding] + [0] * (width - len(r.embedding))) for r in kept]


def plain_lloyd(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(r[2], p) for r in rows[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in rows:
                groups.setdefault(near(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    out = []
    for i, label, v in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return out, books


@pytest.mark.parametrize(("rounds", "owner_rows"), [(6, 8192), (3, 10), (0, 10)])
def test_vector_codes(spark, monkeypatch, rounds, owner_rows):
    monkeypatch.setattr(vector_codes, "OWNER_ROWS", owner_rows)  # salted owners
    df = vectors(spark)
    df = df.unionByName(df.where("vec_id = 12"))  # a repeated row
    want, books = plain_lloyd(plain_integers(df, 4096, 16), 8, 16, rounds)
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    got = vector_codes.with_label_error(vector_codes.compress(df, rounds=rounds))
    assert got.columns == ["vec_id", "label", "score", "text", "code", "error", "codebooks_sha256", "label_error"]
    rows = got.collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=str) == sorted(((i, c, e, sums[label]) for i, c, e, label in want), key=str)
    import hashlib

    assert {r.codebooks_sha256 for r in rows} == {hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()}


def test_vector_codes_edges(spark):
    empty = vectors(spark).where("false")
    assert vector_codes.with_label_error(vector_codes.compress(empty)).count() == 0
    few = vectors(spark).where("vec_id < 3")
    want, _ = plain_lloyd(plain_integers(few, 4096, 16), 8, 16, 6)
    assert [(r.vec_id, r.code, r.error) for r in vector_codes.compress(few).orderBy("vec_id").collect()] == [(i, c, e) for i, c, e, _ in want]
    with pytest.raises(Exception, match="scaled component"):
        vector_codes.compress(spark.createDataFrame([(0, [1e30, 0.0], 1)], "vec_id long, embedding array<float>, label int")).collect()


def test_only_parts_that_change_their_entry_move(spark):
    ints, width = integer_vectors(vectors(spark).select("vec_id", "embedding"), "embedding", 4096, 8)
    starts = ints.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(16).collect()
    book = np.array([r["ints"] for r in starts]).reshape(16, 8, 2).transpose(1, 0, 2)
    members = vector_codes.first_owners(ints, width, book, 2)
    other = book + np.arange(16)[None, :, None] * 40
    moved = vector_codes.one_round([members], [book, other]).collect()
    before = {(r.vec_id, r.position, tuple(r.part)): r.entry for r in members.collect()}
    for r in moved:
        if r.arrived:
            part = np.array([list(r.part)])
            assert r.entry == vector_codes.nearest(part, other[r.position])[0][0] != before[r.vec_id, r.position, tuple(r.part)]
    stayed = sum(r.n for r in moved if not r.arrived)
    assert stayed + sum(r.arrived for r in moved) == members.count()


def plain_negatives(rows, k=5):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None:
            best[i] = min(best.get(i, (label, v)), (label, v))
    out = []
    for a in (i for i in best if i % 10 == 0):
        scored = sorted((-sum(x * y for x, y in zip(best[a][1], v, strict=True)), i, label) for i, (label, v) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == best[a][0]][:k]:
            fits = [(n, -t) for t, n, label in scored if label != best[a][0] and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, rank, n, -s, t) for rank, (n, t) in enumerate(fits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("first", "rows", "anchors", "entries"), [(2048, 4096, 1024, 16), (20, 16, 7, 4), (1, 1000, 1000, 1)])
def test_hard_negatives(spark, monkeypatch, first, rows, anchors, entries):
    for name, value in (("FIRST_ROWS", first), ("GROUP_ROWS", rows), ("GROUP_ANCHORS", anchors)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = vectors(spark)
    df = df.unionByName(df.where("vec_id IN (10, 12)")).unionByName(df.where("vec_id = 20").withColumn("label", F.lit(9)))  # repeated rows, and one id with two labels
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, entries=entries)
    want = plain_negatives(plain_integers(df, 256, 16))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_edges(spark):
    df = vectors(spark)
    assert hard_negatives.mine(df.where("false"), F.lit(True)).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
    one_label = df.withColumn("label", F.lit(1))
    assert hard_negatives.mine(one_label, F.col("vec_id") % 10 == 0).count() == 0
    two = df.where("vec_id IN (0, 5)")
    assert hard_negatives.mine(two, F.lit(True)).count() == 0


def test_cells_come_by_falling_bounds_that_hold(spark):
    ints, width = integer_vectors(vectors(spark).where("vec_id < 300").select("vec_id", "label", "embedding"), "embedding", 256, 2)
    table, index = hard_negatives.build(ints, width, 4)
    rows = table.collect()
    for anchor in (np.array(rows[0].ints), np.array(rows[50].ints), np.zeros(width, dtype=int)):
        order = list(index.by_bound(anchor))
        assert sorted(c for c, _ in order) == sorted({r.cell for r in rows})
        assert all(a[1] >= b[1] for a, b in itertools.pairwise(order))
        bound = dict(order)
        assert all(np.dot(anchor, r.ints) <= bound[r.cell] for r in rows)


def test_products_are_exact():
    a = np.array([[1 << 30, -(1 << 30)], [3, 4]], dtype=np.int64)
    assert products(a, a).tolist() == [[1 << 61, (3 << 30) - (4 << 30)], [(3 << 30) - (4 << 30), 25]]


@pytest.mark.parametrize("name", ["op11_token_counts", "op12_vector_codes", "op13_hard_negatives"])
def test_queries(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    if name == "op11_token_counts":
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert {r.doc_id: r.n_tokens for r in out.collect()} == {k: by_library(t) for k, t in docs.items()}
        assert [f.dataType for f in out.schema] == [T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
        return
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.SQL[name])
    order = [c[0] for c in want.description]
    assert sorted(map(tuple, out.select(*order).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_revisits_leave_other_columns(spark):
    from posterboard.llm import warc

    pages = spark.createDataFrame([(1, "u", "same", "mine", 7, "x", "old"), (2, "u", "same", "mine", 8, "y", "old"), (3, None, None, None, None, None, None)], "page_id long, url string, html string, _sha1 string, _bytes int, _first string, refers_to string")
    out = {r.page_id: r for r in warc.plan_revisits(pages).collect()}
    assert {k: r.refers_to for k, r in out.items()} == {1: None, 2: 1, 3: None}
    assert (out[2]._sha1, out[2]._bytes, out[2]._first) == ("mine", 8, "y")
