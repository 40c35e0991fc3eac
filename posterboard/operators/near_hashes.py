"""Hashes of 64 bits that are near each other, by multi-index hashing without a row for each code that is asked.

A hash has four bands of 16 bits. Two hashes up to max_bits apart are within the radius of a band in one of them at least, so a hash meets those whose code in that band is one of a few hundred around its own.
Hashes go as blobs: a task holds a part of the left by its codes in one band and a slice of the right, in the order of their codes; those of the left with one code look up their part of the right together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a band, and bands.
BAND_BITS, BANDS = 16, 4
#: Hashes of either side that a task holds, about; hashes of a blob; pairs that are compared at once.
SLICE, PIECE, PAIRS = 1 << 20, 1 << 10, 1 << 18
#: Parts of a band's codes, by their first bits, by the radius of the band: the wider, the more work.
_PART_BITS = {0: 1, 1: 2, 2: 3}


def radii(max_bits: int, bands: int = BANDS) -> list[int]:
    """A radius for each band, so that hashes up to max_bits apart are within the radius in one band at least: else they were radius + 1 apart in each, which is max_bits + 1 in all. -1 leaves a band out."""
    spare = max_bits + 1
    return [spare // bands + (k < spare % bands) - 1 for k in range(bands)]


def _parts(max_bits: int) -> list[tuple[int, int]]:
    """Band and first bits of the codes of each part."""
    return [(k, at) for k, r in enumerate(radii(max_bits)) if r >= 0 for at in range(1 << _PART_BITS.get(r, 5))]


def _codes(h: np.ndarray, band: int) -> np.ndarray:
    return (h >> np.uint64(64 - BAND_BITS * (band + 1)) & np.uint64((1 << BAND_BITS) - 1)).astype(np.int64)


def meet(left: np.ndarray, right: np.ndarray, band: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (uint64) at most max_bits apart that are within the radius in this band, and in none before it; with their bits."""
    radius = radii(max_bits)
    masks = np.array([sum(1 << b for b in chosen) for n in range(min(radius[band], BAND_BITS) + 1) for chosen in combinations(range(BAND_BITS), n)], np.int64)
    left, right = left[np.argsort(_codes(left, band))], right[np.argsort(_codes(right, band))]
    first = np.searchsorted(_codes(right, band), np.arange((1 << BAND_BITS) + 1))
    codes, starts = np.unique(_codes(left, band), return_index=True)
    for code, start, end in zip(codes, starts, np.append(starts[1:], len(left)), strict=True):
        at = masks ^ code
        begin, n = first[at], first[at + 1] - first[at]
        total = int(n.sum())
        for some in range(0, total, PAIRS):
            if total <= PAIRS:
                near = right[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)]
            else:
                # which codes hold the rows from some on, and how much of them
                upto = np.cumsum(n)
                a, b = np.clip(some - (upto - n), 0, n), np.clip(some + PAIRS - (upto - n), 0, n)
                m = b - a
                near = right[np.repeat(begin + a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            step = max(1, PAIRS // len(near))
            for row in range(start, end, step):
                mine = left[row : min(row + step, end)]
                bits = np.bitwise_count(mine[:, None] ^ near[None, :]).ravel()
                hit = np.flatnonzero(bits <= max_bits)
                if not len(hit):
                    continue
                l, r = mine[hit // len(near)], near[hit % len(near)]
                new = np.ones(len(hit), bool)
                for k in range(band):
                    if radius[k] >= 0:
                        new &= np.bitwise_count((_codes(l, k) ^ _codes(r, k)).astype(np.uint64)) > radius[k]
                if new.any():
                    yield l[new], r[new], bits[hit][new]


def _search(batches: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Blobs of one unit after another, those of the right first."""
    parts, unit, held, asked = _parts(max_bits), None, [], []
    out: list[tuple] = []

    def run() -> Iterator[pd.DataFrame]:
        if held and asked:
            l, r = (np.frombuffer(b"".join(x), np.uint64) for x in (asked, held))
            for found in meet(l, r, parts[unit[0]][0], max_bits):
                out.append(found)
                if len(out) >= 4096 or len(found[0]) > PAIRS // 4:
                    yield table()

    def table() -> pd.DataFrame:
        l, r, bits = (np.concatenate([x[k] for x in out]) for k in range(3))
        out.clear()
        return pd.DataFrame({"l": l.view(np.int64), "r": r.view(np.int64), "bits": bits.astype(np.int32)})

    for pdf in batches:
        for part, salt, piece, side, blob in zip(pdf["part"], pdf["salt"], pdf["slice"], pdf["side"], pdf["blob"], strict=True):
            if (part, salt, piece) != unit:
                yield from run()
                unit, held, asked = (part, salt, piece), [], []
            (asked if side else held).append(blob)
    yield from run()
    if out:
        yield table()


def _blobs(hashes: np.ndarray) -> Iterator[bytes]:
    for at in range(0, len(hashes), PIECE):
        yield hashes[at : at + PIECE].tobytes()


def near_hashes(left: DataFrame, right: DataFrame, max_bits: int) -> DataFrame:
    """left, right: h, hashes as longs. Returns l, r, bits for distinct hashes at most max_bits apart, each pair once.

    For 12 bits the radii are 3, 2, 2 and 2: 1,108 codes around a hash, which meet 1.7 % of random hashes. The work is a product of both sides still, less what the codes spare, in units of bounded size.
    """
    if not 0 <= max_bits < 64:
        raise ValueError("max_bits is from 0 to 63")
    parts = _parts(max_bits)
    index = {p: i for i, p in enumerate(parts)}
    l, r = (df.select("h").where("h IS NOT NULL").distinct() for df in (left, right))
    slices = lambda df, name: df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / SLICE), F.lit(1)).cast("int").alias(name))
    sizes = F.broadcast(slices(l, "n_l").crossJoin(slices(r, "n_r")))  # one row

    def pack_right(batches):
        for pdf in batches:
            for (at, n_l), one in pdf.groupby(["deal_r", "n_l"]):
                for blob in _blobs(one["h"].to_numpy(np.int64).view(np.uint64)):
                    yield pd.DataFrame({"slice": [at], "n": [n_l], "blob": [blob]})

    def pack_left(batches):
        for pdf in batches:
            for (at, n_r), one in pdf.groupby(["deal_l", "n_r"]):
                h = one["h"].to_numpy(np.int64).view(np.uint64)
                for k, radius in enumerate(radii(max_bits)):
                    if radius < 0:
                        continue
                    first = _codes(h, k) >> BAND_BITS - _PART_BITS.get(radius, 5)
                    rows = [(index[k, int(x)], at, n_r, blob) for x in np.unique(first) for blob in _blobs(h[first == x])]
                    yield pd.DataFrame(rows, columns=["part", "salt", "n", "blob"])

    deal = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int").alias(n.replace("n_", "deal_"))
    count_to = lambda n, name: F.explode(F.sequence(F.lit(0), n - 1)).alias(name)
    held = r.crossJoin(sizes).select("h", deal("n_r"), "n_l").mapInPandas(pack_right, "slice int, n int, blob binary")
    held = held.select(count_to(F.lit(len(parts)), "part"), "slice", "n", "blob").select("part", count_to(F.col("n"), "salt"), "slice", F.lit(0).alias("side"), "blob")
    asked = l.crossJoin(sizes).select("h", deal("n_l"), "n_r").mapInPandas(pack_left, "part int, salt int, n int, blob binary")
    asked = asked.select("part", "salt", count_to(F.col("n"), "slice"), F.lit(1).alias("side"), "blob")
    unit = ["part", "salt", "slice"]
    # a stated number of partitions: blobs are few bytes and much work
    units = held.unionByName(asked).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit)
    return units.sortWithinPartitions(*unit, "side").mapInPandas(lambda batches: _search(batches, max_bits), "l long, r long, bits int")
