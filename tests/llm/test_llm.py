"""Each operator against a brute-force version or an exact round trip, on small tables with the awkward cases."""

import base64
import collections
import hashlib
import io
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from conftest_words import words
from pyspark.sql import functions as F

from posterboard.llm import chat, katz, ngram_join, packing, pieces, quality_classifier, quality_rules, queries, spotsigs, url_reputation, warc
from posterboard.llm.components import components


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def brute_classes(rows, threshold, n):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[find(j)] = find(i)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted(((d, len(sets[i]), smallest.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("threshold", "n"), [(90, 3), (80, 5)])
def test_ngram_join(spark, awkward, nothing, threshold, n):
    rng = random.Random(threshold)
    vocabulary = [f"w{i}" for i in range(60)]
    made = []
    for k in range(8):  # groups of near copies, with chains
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 40, 120]))]
        for _ in range(6):
            base = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            made.append((100 + len(made), " ".join(base)))
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similarity_classes(docs, threshold, n).collect()), key=str)
    assert got == brute_classes(rows_of(docs), threshold, n)
    if n == 3:
        assert ngram_join.similarity_classes(nothing).count() == 0


def test_link_counts_in_blocks():
    """Units of block pairs give the same links as all pairs, with few and with many candidates."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        s[rng.integers(0, 80, rng.integers(0, 7))] = rng.integers(0, 1 << 60, dtype=np.uint64)
        sets.append(np.unique(s))
    weights = rng.integers(1, 4, 150)
    want = np.zeros(150, dtype=int)
    for i, j in itertools.combinations(range(150), 2):
        c = len(np.intersect1d(sets[i], sets[j]))
        if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
            want[i] += weights[j]
            want[j] += weights[i]
    whole, root = ngram_join.link_counts(sets, weights, np.ones(150, dtype=bool), 90)
    assert (whole == want).all() and len(set(root)) <= 150
    left = np.arange(150) < 70
    cross, _ = ngram_join.link_counts(sets, weights, left, 90)
    halves = np.concatenate([ngram_join.link_counts(sets[:70], weights[:70], np.ones(70, dtype=bool), 90)[0], ngram_join.link_counts(sets[70:], weights[70:], np.ones(80, dtype=bool), 90)[0]])
    assert (cross + halves == want).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_url_rules_and_reputation(spark):
    urls = ["http://a.com/x", "https://WWW.Example.com/en/1?q", "http://sub.example.com/en/1", "http://example.com/fr/", "http://x.net/es/2#t", "x.net/es/", None, "http://b.org", "http://com/y", "http://notnet/es/", "a://b://c.net/fr/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(100 + i, f"http://spam.org/{i}", 1) for i in range(40)] + [(200 + i, f"http://good.org/{i}", 0) for i in range(60)] + [(300, "http://one.org/1", 1)], "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages.withColumn("host", F.lit("clash"))).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(11)] == [
        ("a.com", "/x", "com/", "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("sub.example.com", "/en/1", "example.com/en/", "block"), ("example.com", "/fr/", "com/", "allow"),
        ("x.net", "/es/2", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.org", "", None, "allow"), ("com", "/y", "com/", "allow"), ("notnet", "/es/", None, "allow"), ("b:", "//c.net/fr/", None, "allow"),
    ]
    assert got[100].verdict == "block" and got[200].verdict == "allow" and got[300].verdict == "allow"
    assert 0.03 < got[300].bad_rate < 0.97  # one page alone is drawn to its parents
    assert url_reputation.judge_urls(pages.limit(0)).count() == 0


def plain_reputation(pages):
    """The beta-binomial levels in plain loops. pages: host, bad (0, 1 or None)."""
    low, high = url_reputation.STRENGTH
    hosts = {h: [float(sum(b for x, b in pages if x == h and b is not None)), float(sum(x == h and b is not None for x, b in pages))] for h, _ in pages}
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    tops = {d: d.split(".")[-1] for d in domain.values()}
    add = lambda part, below: {k: [sum(below[x][i] for x in below if part[x] == k) for i in (0, 1)] for k in set(part.values())}
    domains = add(domain, hosts)
    suffixes = add(tops, domains)
    p0 = (sum(b for b, _ in suffixes.values()) + 0.5) / (sum(n for _, n in suffixes.values()) + 1)

    def level(children, parent, above):
        out = {}
        for q in set(parent.values()):
            mine = {c: v for c, v in children.items() if parent[c] == q}
            p, worth = above[q]
            seen = [(b, n) for b, n in mine.values() if n]
            total = sum(n for _, n in seen)
            spread = total - sum(n * n for _, n in seen) / total if total else 0
            between = (sum(n * (b / n - p) ** 2 for b, n in seen) - (len(seen) - 1) * p * (1 - p)) / spread if spread else 0
            strength = min(high, max(low, p * (1 - p) / between - 1)) if between > 0 else high
            prior = min(strength, worth)
            for c, (b, n) in mine.items():
                out[c] = (p, worth) if len(seen) == 1 and n and q else ((b + prior * p) / (n + prior), n + prior)
        return out

    s2 = level(suffixes, dict.fromkeys(suffixes, ""), {"": (p0, high)})
    d2 = level(domains, tops, s2)
    h2 = level(hosts, domain, d2)
    limit = max(url_reputation.MIN_BAD, url_reputation.TIMES * p0)
    return {h: (m, m - url_reputation.Z * math.sqrt(m * (1 - m) / (t + 1)) > limit) for h, (m, t) in h2.items()}


def test_reputation_is_plain_beta_binomial(spark):
    rng = random.Random(6)
    pages = []
    for top in ("org", "net"):
        for d in range(5):
            rate = rng.random() ** 3
            for h in range(5):
                pages += [(f"h{h}.d{d}.{top}", int(rng.random() < rate) if rng.random() < 0.8 and h else None) for _ in range(rng.randint(1, 25))]
    pages += [(f"s{i % 30}.bad.org", 1) for i in range(300)] + [("new.bad.org", None), ("new.fresh.org", None), ("only.one.biz", 1), ("first.zone", None)]
    want = plain_reputation(pages)
    df = spark.createDataFrame([(i, f"http://{h}/x", b) for i, (h, b) in enumerate(pages)], "page_id long, url string, bad int")
    got = {r.host: (r.bad_rate, r.verdict == "block") for r in url_reputation.judge_urls(df).select("host", "bad_rate", "verdict").distinct().collect()}
    assert got.keys() == want.keys()
    for h, (rate, blocked) in want.items():
        assert got[h][0] == pytest.approx(rate, rel=1e-9) and got[h][1] == blocked, h
    assert want["new.bad.org"][1] and not want["new.fresh.org"][1]  # a new host of a bad domain is blocked, one of an unknown domain isn't


def brute_katz(rows, discount, order):
    toks = [[w.encode() for w in words(t)] + [None] for _, t, _ in rows]
    seen = [collections.Counter() for _ in range(order)]
    for x, (_, _, train) in zip(toks, rows, strict=True):
        for k in range(order):
            if train:
                seen[k].update(zip(*(x[i:] for i in range(k + 1)), strict=False))
    levels = [discount(c) for c in seen]
    d = lambda k, c: levels[k][c - 1] if c <= katz.CUT else 1.0
    one = seen[0]
    n, v = sum(one.values()), len(one)
    mass1 = sum(d(0, c) * c for c in one.values())
    whole1 = n + (mass1 >= n)
    after = collections.defaultdict(list)
    for c in seen[1:]:
        for g in c:
            after[g[:-1]].append(g[-1])
    kept, facts = {}, {}

    def history(h):
        """(denominator, alpha) of a history that was seen."""
        if h not in facts:
            c = seen[len(h)]
            total = sum(c[*h, x] for x in after[h])
            mass = sum(d(len(h), c[*h, x]) * c[*h, x] for x in after[h])
            whole = total + (mass >= total)
            facts[h] = whole, (1 - mass / whole) / (1 - sum(p(h[1:], x) for x in after[h]))
        return facts[h]

    def p(h, w):
        """P(w | h), recursively."""
        if (h, w) not in kept:
            if not h:
                kept[h, w] = 1.0 if not n else d(0, one[w,]) * one[w,] / whole1 if (w,) in one else 1 - mass1 / whole1
            elif not after[h]:
                kept[h, w] = p(h[1:], w)
            else:
                c, (whole, alpha) = seen[len(h)], history(h)
                kept[h, w] = d(len(h), c[*h, w]) * c[*h, w] / whole if (*h, w) in c else alpha * p(h[1:], w)
        return kept[h, w]

    scores = [sum(math.log10(p(tuple(x[max(0, i - order + 1) : i]), x[i])) for i in range(len(x))) for x in toks]
    base = [sum(math.log10((one[w,] + 1) / (n + v + 1)) for w in x) for x in toks]
    norm = [sum(p(h, w) for (w,) in one) + p(h, b"<never>") for h in [*list(after)[:15], *list(after)[-15:]]]
    return n, scores, base, [sum((w,) in one for w in x) for x in toks], norm


@pytest.mark.parametrize(("chunk", "order"), [(50, 3), (10_000_000, 3), (50, 2), (400, 4)])
def test_katz(spark, awkward, monkeypatch, chunk, order):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(katz, "HOT", 20)
    monkeypatch.setattr(katz, "MIN_RANGES", 9)
    rng = random.Random(chunk)
    made = [(1000 + i, " ".join(rng.choice("a b c d e f g h i j k l m n o p".split()) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(awkward.select("doc_id", "text").where("doc_id IS NOT NULL AND doc_id != 9 AND doc_id != 8"))
    docs = docs.withColumn("train", F.when(F.col("doc_id") % 5 != 0, True))
    rows = [(r.doc_id, r.text, bool(r.train)) for r in docs.collect()]
    got = {r.doc_id: r for r in katz.score_documents(docs, order).collect()}
    n, scores, base, known, norm = brute_katz(rows, lambda c: katz.Level.of(0, 0, [sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)]).discount[1 : katz.CUT + 1], order)
    assert len(got) == len(rows) and all(abs(x - 1) < 1e-9 for x in norm)
    for (d, t, train), s, b, k in zip(rows, scores, base, known, strict=True):
        r = got[d]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train, len(words(t)) + 1, k, n)
        assert r.score == pytest.approx(s, rel=1e-9) and r.base_score == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("ranges", [5, 1 << 61])
def test_katz_sorts_a_level_once(monkeypatch, ranges):
    """A chunk's n-grams by plain Python, ordered by range, suffix and first word; one sort of tokens a level (two where a key doesn't fit 64 bits)."""
    texts = [[1, 2, 1, 2, 1, 0], [0], [2, 1, 2, 3, 0], [1, 2, 0]]
    chunk = katz.Chunk.__new__(katz.Chunk)
    chunk.words, chunk.local = np.arange(4, dtype=np.uint64), np.array(sum(texts, []), dtype=np.int32)
    chunk.ranges, chunk.total_tokens, chunk.number, chunk.key = ranges, 20, np.arange(4), katz._mixed(np.arange(4))
    chunk.place, chunk.in_train = np.array([i for t in texts for i in range(len(t))]), np.array([n != 2 for n, t in enumerate(texts) for _ in t])
    chunk.levels, chunk.at, chunk.total, chunk.first = {}, {1: chunk.local}, {1: np.bincount(chunk.local)}, {1: np.arange(4)}
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(katz.np, "argsort", lambda a, *b, **c: (sorts.append(len(a)), argsort(a, *b, **c))[1])
    for k in (2, 3):
        sorts.clear()
        level = chunk.grams(k, 4)
        assert len(sorts) == (1 if ranges == 5 else 2)
        spelled = list(zip(*(map(int, c) for c in chunk.spell(k, np.arange(len(level.word)))), strict=True))
        seen = collections.Counter(tuple(t[i : i + k]) for n, t in enumerate(texts) if n != 2 for i in range(len(t) - k + 1))
        every = [tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)]
        assert sorted(spelled) == sorted(set(every)) and level.count.tolist() == [seen[g] for g in spelled]
        assert [spelled[i] for i in chunk.at[k] if i >= 0] == every
        assert [g[-1] for g in spelled] == level.word.tolist()
        assert (order := list(zip(level.part.tolist(), level.suffix.tolist(), level.first.tolist(), strict=True))) == sorted(order)
        chunk.total[k] = level.count + 1


def test_katz_vocabulary():
    words, place = katz.vocabulary(np.array([7, 1 << 63, 7, 2, 1 << 63, 7], dtype=np.uint64))
    assert words.tolist() == [2, 7, 1 << 63] and place.tolist() == [1, 2, 1, 0, 2, 1]


def test_katz_without_training(spark, nothing):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, train boolean")
    assert {(r.doc_id, r.score, r.train_tokens) for r in katz.score_documents(docs).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert katz.score_documents(nothing.select("doc_id", "text", F.lit(True).alias("train"))).count() == 0


def test_warc_round_trip(spark, awkward, nothing):
    pages = awkward.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x/ \r\n"), "doc_id").alias("url"), F.col("text").alias("html"))
    folder = warc.fresh_path(spark, "warc-test")
    files = warc.write_archives(warc.plan_revisits(pages), folder)
    want = collections.Counter()
    rows = pages.collect()
    first = {}
    for r in rows:
        h = r.html or ""
        if r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    for r in rows:
        h = (r.html or "").encode()
        to = first.get(r.html or "")
        revisit = to is not None and to != r.page_id
        want[(r.page_id, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", to if revisit else None)] += 1
    for split in (1 << 22, 700, 64):
        read = warc.read_archives(files, folder, split).collect()
        got = collections.Counter((warc._page_id(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, warc._page_id(r.refers_to)) for r in read)
        assert got == want
        assert all(hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in read if r.record_type == "response")
    large = warc.plan_revisits(pages, min_bytes=10_000).where("refers_to IS NOT NULL").count()
    assert large == 0
    assert warc.read_archives(warc.write_archives(warc.plan_revisits(nothing.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))), folder), folder).count() == 0


def test_warc_false_magic():
    """The magic inside a payload, or before bytes that are no gzip, is no record; any split finds each record once."""
    rng = random.Random(0)
    payloads = [warc.MAGIC * 50 + bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) for _ in range(30)]
    data = b"".join(warc.write_record(i, f"u{i}", p, warc.payload_digest(p)) for i, p in enumerate(payloads))
    data += zlib.compressobj(9, zlib.DEFLATED, 31).compress(b"not a record") + warc.MAGIC + b"junk"
    for split in (50, 999, len(data)):
        found = [at for s in range(0, len(data), split) for at, _ in warc.records_in(io.BytesIO(data), len(data), s, min(len(data), s + split))]
        assert len(found) == len(set(found)) == 30


def brute_signatures(text):
    table = str.maketrans(spotsigs.UPPER + "\t\n\x0b\x0c\r", spotsigs.LOWER + "     ", spotsigs._DROPPED)
    w = [x for x in (text or "").translate(table).split(" ") if x]
    anchors = set(spotsigs.ANCHORS)
    w2 = [x for i, x in enumerate(w) if not (x in anchors and i + 1 < len(w) and w[i + 1] in anchors)]
    out = set()
    for i, x in enumerate(w2):
        chain = [y for y in w2[i + 1 : i + 4] if y not in anchors][:2]
        if x in anchors and len(chain) == 2:
            out.add((x, *chain))
    return out or {tuple(w)}


def test_spotsigs(spark, awkward, nothing):
    rows = sorted(rows_of(awkward), key=lambda r: -(10**9) if r[0] is None else r[0], reverse=True)
    got = {(r.doc_id, r.text): r for r in spotsigs.edited_likeness(awkward).select("doc_id", "text", "edited", "sigs", "edited_sigs", "next_sigs", spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near")).collect()}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        r, k = got[(d, t)], len(t) // 3
        if d != 9:
            assert r.edited == t[: len(t) - k] + after[:k]
            a, b = brute_signatures(t), brute_signatures(r.edited)
            assert len(r.sigs) == len(a) and r.near == pytest.approx(len(a & b) / len(a | b)) and len(r.next_sigs) == len(brute_signatures(after))
    assert spotsigs.edited_likeness(nothing).count() == 0
    one = spotsigs.edited_likeness(awkward.where("doc_id = 7")).first()
    assert one.next_text == one.text
    assert spark.range(1).select(spotsigs.likeness(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2), F.lit(3)), 0.5).alias("x")).first().x == 0.0


def test_spotsigs_cells(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "CELL_ROWS", 3)
    ids = sorted(random.Random(1).sample(range(-500, 10_000), 60), reverse=True)
    rows = spotsigs.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), lambda d: d, ["text"])
    assert {r.doc_id: r.next_text for r in rows.collect()} == {i: f"t{ids[(k + 1) % 60]}" for k, i in enumerate(ids)}


def test_pieces_is_the_library(spark, awkward, nothing):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=model), pieces.PieceTable(model)
    rng = random.Random(1)
    bits = [*"aeiothns ,.▁\n\té✨漢ñ\x00", "  ", "    ", "the", "ing", "<s>", "<0x0A>", "�", " " * 17]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [" " * k + "漢" for k in range(70)]
    for t in texts:
        assert mine.encode(t) == lib.encode(t) and mine.decode(mine.encode(t)) == lib.decode(lib.encode(t)), repr(t)
    for r in pieces.encode_documents(awkward, model, decode=True).collect():
        assert r.ids == lib.encode(r.text or "") and r.decoded == lib.decode(r.ids)
    assert pieces.encode_documents(nothing, model).count() == 0


def test_piece_pairs_are_merging():
    """The pair test against merging step by step."""
    import public_tokenizers

    t = pieces.PieceTable(public_tokenizers.path("piece_bpe_32k.model"))

    def merged(s):
        parts = list(s)
        while True:
            best = min(((t.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    names = [p for p in t.halves if len(p) < 7]
    rng = random.Random(2)
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names).lstrip("▁") or "a"
        if b in t.rank and merged(b) == [b]:
            assert t.compatible(a, b) == (merged(a + b) == [a, b]), (a, b)


def brute_counts(text):
    text = text or ""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(awkward):
    got = quality_rules.document_counts(awkward.select("doc_id", "text", F.lit(3).alias("n_words"))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)


def test_frequent_lines(spark, awkward, nothing):
    letters = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    body = lambda i: " ".join(f"unique{letters(i)}x{letters(k)}" for k in range(60))
    common = " ".join(f"menu{k}" for k in range(300))
    rows = [(i, body(i) + "\n" + (common + f" {i}" if i % 2 else common), "s") for i in range(60)] + [(100 + i, body(200 + i), "s") for i in range(40)] + [(500, common, "t"), (501, body(0) + "\n" + common, "t")]
    out = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # digits become one sign, so lines that differ in them are one: 30 texts share it, over the limit of 20
    assert out[0].kept and out[0].words_left == out[0].n_words  # the first holds the line
    assert not out[2].kept and out[2].words_left == 60 and all(out[100 + i].kept for i in range(40))
    assert out[500].kept and out[501].kept  # rare on this host
    every = quality_rules.apply_rules(awkward)
    assert every.count() == awkward.count() and quality_rules.apply_rules(nothing).count() == 0
    kept = quality_rules.keep_good(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in every.where("kept").collect()}


def test_frequent_lines_leave_the_text(spark):
    letters = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    body = lambda i: [" ".join(f"w{letters(i)}x{letters(j)}x{letters(k)}" for k in range(30)) for j in range(3)]
    menu = "Home | News 7"  # digits, case and spaces don't matter to the count
    made = {i: "\n".join([body(i)[0], "", menu.replace("7", str(i % 10)), body(i)[1], "  HOME  | news 5 ", body(i)[2], " \t", ""]) for i in range(1, 41)}
    rows = [(i, t, "s", 1) for i, t in made.items()] + [(7, made[7], "s", 2), (100, "\n".join([*body(100), menu]), "t", 1), (101, "\n".join(body(101)), "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {(r.doc_id, r.copy): r.text for r in out.collect()}
    assert got[1, 1] == made[1]  # the first document keeps its lines
    for i in range(2, 41):
        assert got[i, 1] == "\n".join([body(i)[0], "", body(i)[1], body(i)[2], " \t", ""])  # in order, blank lines too
    assert got[7, 2] == got[7, 1]  # repeated rows alike
    assert got[100, 1] == rows[-2][1] and got[101, 1] == rows[-1][1]  # rare on this host; nothing to remove
    assert quality_rules.keep_good(docs.withColumnsRenamed({"copy": "key"}).withColumn("lines_gone", F.lit(3))).columns[-2:] == ["key", "lines_gone"]
    twins = quality_rules.keep_good(docs.where("doc_id < 41").unionByName(docs.where("doc_id = 9").withColumns({"doc_id": F.lit(None).cast("long"), "text": F.concat("text", F.lit("end"))})))
    assert next(r.text for r in twins.collect() if r.doc_id is None) == got[9, 1] + "end"  # a row without an id is a document like any other
    left = {r.doc_id: r.words_left for r in quality_rules.apply_rules(docs.where("copy = 1")).collect()}
    assert all(len(words(t)) == left[d] for (d, _), t in got.items())


def test_bucket_bounds_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(0, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        k = rng.randint(1, 4)

        def padded(bounds):
            return sum(int(c) * next(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))

        best = min(padded((*x, int(lengths[-1]))) for m in range(min(k, len(lengths))) for x in itertools.combinations(map(int, lengths[:-1]), m))
        got = packing.optimal_bounds(lengths, counts, k)
        assert len(got) <= k and padded(got) == best
    assert packing.optimal_bounds(np.array([]), np.array([]), 4) == []


def test_pack(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 4)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") * 7 % 200).cast("int")), " ").alias("text")).unionByName(awkward.select("doc_id", "text"))
    rows = packing.pack(docs, "doc_id", packing.n_words(F.col("text")), n_buckets=5, token_budget=400).collect()
    assert len(rows) == docs.count()
    buckets = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_len and r.slot < r.capacity == max(1, 400 // max(1, r.bucket_len))
        buckets[r.bucket].append((r.batch, r.slot))
    for b, seats in buckets.items():
        capacity = next(r.capacity for r in rows if r.bucket == b)
        assert sorted(seats) == [divmod(i, capacity) for i in range(len(seats))]
    assert packing.pack(nothing, "doc_id", packing.n_words(F.col("text"))).count() == 0


def test_pack_lengths(spark, monkeypatch):
    got = [r.n for r in spark.createDataFrame([(x,) for x in (0, 1, 127, 128, 129, 255, 257, 100_001)], "x long").select(packing.rounded_length(F.col("x"), 7).alias("n")).collect()]
    assert got == [0, 1, 127, 128, 130, 256, 260, 100_352]
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else i * 13 % 700) for i in range(200)], "rows long, n long")
    exact = packing.pack(docs, "rows", F.col("n"), 4, 300).collect()
    assert len(exact) == 200 and {r.n_tokens for r in exact if r.rows % 9 == 0} == {0}
    top = collections.defaultdict(int)
    for r in exact:
        top[r.bucket] = max(top[r.bucket], r.n_tokens)
    assert all(r.bucket_len == top[r.bucket] for r in exact) and any(r.bucket_len > 300 and r.capacity == 1 for r in exact)
    monkeypatch.setattr(packing, "MAX_LENGTHS", 20)
    monkeypatch.setattr(packing, "PRECISION", 4)
    rounded = packing.pack(docs, "rows", F.col("n"), 4, 300).collect()
    assert len(rounded) == 200 and all(r.n_tokens <= r.bucket_len for r in rounded)
    with pytest.raises(ValueError, match="key"):
        packing.pack(docs.withColumnRenamed("rows", "batch"), "batch", F.col("n"))


def test_pack_does_not_depend_on_how_many_lengths_there_are(spark, monkeypatch):
    """Lengths that stay in a table get the bounds that the driver would choose; few buckets of many lengths, many of few, ties (evenly spaced lengths), and a length that most rows have."""
    rng = random.Random(5)
    odd = [rng.randint(0, 100_000) for _ in range(160)]
    for lengths, k, limit in ((odd + [70_001] * 90, 5, 20), ([n for n in range(4_090, 4_290, 5) for _ in range(2)], 4, 7), ([9_000, 9_001, 70_000], 16, 1)):
        docs = spark.createDataFrame(list(enumerate(lengths)), "rows long, n long")
        monkeypatch.setattr(packing, "MAX_LENGTHS", 65_536)
        one = sorted(packing.pack(docs, "rows", F.col("n"), k, 300_000).collect())
        counts = collections.Counter(lengths)
        bounds = packing.optimal_bounds(np.array(sorted(counts)), np.array([counts[n] for n in sorted(counts)]), k)
        assert sorted({r.bucket_len for r in one}) == bounds
        monkeypatch.setattr(packing, "MAX_LENGTHS", limit)
        assert sorted(packing.pack(docs, "rows", F.col("n"), k, 300_000).collect()) == one


def plain_ftrl(rows, epochs):
    """FTRL-proximal as published, a weight at a time; rows are dictionaries of values by place."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality_classifier.L1:
            return 0.0
        return -(z[i] - math.copysign(quality_classifier.L1, z[i])) / ((quality_classifier.BETA + math.sqrt(n[i])) / quality_classifier.ALPHA + quality_classifier.L2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_classifier.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_classifier_is_plain_ftrl(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SHARDS", 1)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("aa bb cc dd ee ff, !! Gg".split()) for _ in range(rng.randint(0, 25))), i % 2) for i in range(60)]
    hasher, bias = quality_classifier.Hasher(), quality_classifier._MASK + 1
    dense = {}
    for i, t, _ in rows:
        at, x = hasher.features(t)
        dense[i] = dict(zip(map(int, at), map(float, x), strict=True)) | {bias: 1.0}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), "doc_id").collect()]
    want = plain_ftrl([(dense[i], i % 2) for i in order], quality_classifier.EPOCHS)
    got = quality_classifier.train(docs, labels)
    assert {i for i in range(len(got)) if got[i]} == {i for i, w in want.items() if w}
    assert all(got[i] == pytest.approx(w, rel=1e-4, abs=1e-6) for i, w in want.items())
    for r in quality_classifier.score(docs.withColumn("score", F.lit("clash")), got).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(want[i] * x for i, x in dense[r.doc_id].items()))), rel=1e-4)


def test_classifier_learns(spark, awkward, nothing):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["river", "town", "field", "mill", "barley", "spring"]) + str(rng.randint(0, 99)) for _ in range(80))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(3, 0), (3, None), (None, 1)], "doc_id long, quality int")
    w = quality_classifier.train(docs, labels.where("doc_id % 4 != 0 OR doc_id IS NULL"))
    out = {r.doc_id: r.score for r in quality_classifier.score(docs, w).collect()}
    held = [(out[d], q) for d, _, q in rows if d % 4 == 0]
    assert sum((s >= 0.5) == bool(q) for s, q in held) >= 0.97 * len(held)
    scored = quality_classifier.score(awkward, w).collect()
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == awkward.count()
    assert quality_classifier.score(nothing, w).count() == 0
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs.limit(3), none).collect()} == {0.5}


def test_chat(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|x", "a\nb", "", None, "<|" * 50, "\\n", "x<"]
    roles = ["user", "assistant", "system", None, "we<|ird\nro\\le", "user\\n"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(roles), rng.choice(odd)) for c in range(60) for t in range(rng.randint(1, 6))] + [(None, None, "user", "x"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("*", chat.parse_formatted(F.col("formatted")).alias("read"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    every = collections.defaultdict(list)
    for c, t, r, x in rows:
        every[c].append(((t is not None, t or 0), r or "", x or ""))
    for c, turns in every.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].read] == [t[1:] for t in turns]
        assert got[c].loss == "".join(x for _, r, x in turns if r == "assistant") and got[c].n_turns == len(turns)
        state = "start"
        for _, r, _ in turns:
            state = r if r in chat.CHATML.transitions.get(state, ()) else "error"
        assert got[c].state == state and got[c].valid == (state in chat.CHATML.final)
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(map(str, (r[i] for i in at))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_has_a_row_per_row(spark, sf, name):
    table = "pages" if name == "op4_warc" else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline(spark, sf, tmp_path):
    """Each stage on its own input against a brute-force version of what it decides."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in p.STAGES:
        out = stage(spark, at, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality_classifier":
            good = {r.doc_id for r in quality_classifier.score(at, quality_classifier.train(at, spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"))).where("score >= 0.3").collect()}
            assert kept == good
        if name == "quality_rules":
            base = {d for d, t in rows_of(at) if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
            assert kept <= base and len(kept) >= 0.9 * len(base)
        if name == "ngram_join":
            assert kept == {c for _, _, c, _ in brute_classes(rows_of(at), 80, 5)}
        if name == "packing":
            assert kept == {d for d, _ in rows_of(at)}
        at = after
