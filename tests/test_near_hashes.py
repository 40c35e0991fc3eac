"""Near hashes of 64 bits by parts of their codes, against all pairs."""

import random

import numpy as np
import pytest

from posterboard.operators import near_hashes as N


def hashes(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(3)] + [0, 2**64 - 1]
    return sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 15))) for _ in range(n)})


def signed(h):
    return h - 2**64 if h >> 63 else h


@pytest.mark.parametrize("bits", [0, 3, 12, 13])
def test_bands_together_meet_each_pair_once(monkeypatch, bits):
    """However few pairs are compared at once."""
    left, right = hashes(1, 150), hashes(2, 150) + hashes(1, 20)
    want = sorted((x, y, (x ^ y).bit_count()) for x in left for y in set(right) if (x ^ y).bit_count() <= bits)
    for pairs in (1 << 18, 7):
        monkeypatch.setattr(N, "PAIRS", pairs)
        got = [tuple(map(int, row)) for k, r in enumerate(N.radii(bits)) if r >= 0 for found in N.meet(np.array(left, np.uint64), np.array(sorted(set(right)), np.uint64), k, bits) for row in zip(*found)]
        assert sorted(got) == want


def test_near_hashes_in_slices(spark, monkeypatch):
    """Units of few hashes give the pairs of one; a hash goes to a part of the codes of each band, not to each code around it."""
    left, right = hashes(3, 300), hashes(4, 200)
    want = sorted((x, y, (x ^ y).bit_count()) for x in left for y in right if (x ^ y).bit_count() <= 12)
    l, r = (spark.createDataFrame([(signed(h),) for h in x] * 2 + [(None,)], "h long") for x in (left, right))
    monkeypatch.setattr(N, "SLICE", 64)
    df = N.near_hashes(l, r, 12)
    assert sorted((a % 2**64, b % 2**64, n) for a, b, n in map(tuple, df.collect())) == want and len(want) > 100
    assert N.near_hashes(l, r.where("false"), 12).isEmpty() and N.near_hashes(l.where("false"), r, 12).isEmpty()
    with pytest.raises(ValueError):
        N.near_hashes(l, r, 64)
