"""The join over SpotSigs sets against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from posterboard.llm import spotsigs


def brute(sets, threshold):
    """sets: {key: (doc_id, set)}. class and number of links by key."""
    keys, up = list(sets), {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    n = dict.fromkeys(keys, 0)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                n[a] += 1
                n[b] += 1
                up[find(a)] = find(b)
    least = {}
    for k in keys:
        d = sets[k][0]
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return {k: (n[k], least.get(find(k))) for k in keys}


def texts(rng):
    words = [f"w{i}" for i in range(300)]
    common = ["the", "of", "and", "a"]
    out = []
    for _ in range(12):
        base = [w for _ in range(rng.choice([3, 8, 40, 70])) for w in (rng.choice(common), rng.choice(words), rng.choice(words))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 3, 9])]))
    out += ["", None, " .,; ", "no anchors here", "No anchors, here!", "the", "the of", out[0], out[0]]
    return out


@pytest.mark.parametrize("threshold,salt", [(80, 512), (80, 2), (50, 3), (95, 1)])
def test_classes(spark, monkeypatch, threshold, salt):
    monkeypatch.setattr(spotsigs, "SALT_ROWS", salt)
    rows = [(i + 10, t) for i, t in enumerate(texts(random.Random(threshold)))]
    rows += [(None, rows[3][1]), (None, "all alone the lonely word"), rows[5], (12, "same id the other text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("sigs", "row", "weight", "d1")})
    sets = {r.k: (r.doc_id, frozenset(r.s) if (r.text or "").strip(" .,;") else frozenset()) for r in docs.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    want = brute(sets, threshold)
    assert sum(n for n, _ in want.values()) > 60
    got = spotsigs.similarity_classes(docs, threshold).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_signatures, r.n_links, r.class_id) for r in got))) == sorted(map(repr, ((d, len(s), *want[k]) for k, (d, s) in sets.items())))


def test_classes_of_nothing(spark, nothing):
    assert spotsigs.similarity_classes(nothing).count() == 0
    with pytest.raises(ValueError):
        spotsigs.similarity_classes(nothing, 100)


def test_length_classes(spark):
    """Lengths that can be alike enough are in neighbouring classes, powers of the ratio included."""
    for threshold in (50, 80, 90):
        rows = spark.range(1, 3000).select("id", spotsigs.length_class(F.col("id"), threshold / 100).alias("c")).collect()
        cls = {r.id: r.c for r in rows}
        assert all(0 <= cls[n] - cls[-(-n * threshold // 100)] <= 1 for n in cls)


def test_next_at_both_ends(spark):
    """Ids at both ends of a long have a next one too."""
    ids = [2**63 - 1, 2**63 - 2, 5, 4, 0, -7, -(2**63) + 1, -(2**63)]
    rows = spotsigs.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), lambda d: d, ["text"])
    assert {r.doc_id: r.next_text for r in rows.collect()} == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}
