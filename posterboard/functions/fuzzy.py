"""Likeness of names and of records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import location_state, normalize_key, normalize_location

CERTAIN, LIKELY = 0.90, 0.72
#: Weights of date, location and title.
WEIGHTS = (0.45, 0.30, 0.25)
SAME_DAY_AND_PLACE = 0.92
#: Day gaps beyond which a pair can't be a duplicate, can't be a possible one, and scores 0.
DUPLICATE_GAP, POSSIBLE_GAP, NO_GAP = 1, 3, 7


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of a."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, 0 to 100."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a window of the longer; windows at the ends may be shorter.

    A window that starts with a character the shorter text lacks is no better than the next one (at the left end, one that ends with such a character than the one before), so it isn't compared.
    """
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0.0 if long else 100.0
    places: dict[str, int] = {}
    for i, ch in enumerate(short):
        places[ch] = places.get(ch, 0) | 1 << i
    bits, full, best = [places.get(ch, 0) for ch in long], (1 << n) - 1, 0.0
    for i in range(1 - n, len(long)):
        start, end = max(0, i), min(i + n, len(long))
        if not (bits[start] if i >= 0 else bits[end - 1]):
            continue
        row = full
        for hit in bits[start:end]:
            if hit:
                both = row & hit
                row = ((row + both) | (row - both)) & full
        best = max(best, 200.0 * (n - row.bit_count()) / (n + end - start))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of the sets of words: 100 if one holds the other, else the best of what they share and what each has besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (one and two):
        return 100.0
    joined = [f"{both} {rest}".strip() for rest in (one, two)]
    best = ratio(*joined)
    return max(best, *(ratio(both, j) for j in joined)) if both else best


def name_likeness(a: str, b: str) -> float | None:
    if not a or not b:
        return None
    words = token_set_ratio(a, b)
    return 1.0 if words == 100 else max(words, partial_ratio(a, b)) / 100


class Likeness:
    """name_likeness of pairs that come again, and a bound that is quickly found: no more characters can be in common than both texts have."""

    def __init__(self):
        self.known: dict[tuple[str, str], float | None] = {}
        self.counts: dict[str, tuple[Counter, int]] = {}

    def __call__(self, a: str, b: str) -> float | None:
        if (a, b) not in self.known:
            self.known[a, b] = name_likeness(a, b)
        return self.known[a, b]

    def _count(self, a: str) -> tuple[Counter, int]:
        if a not in self.counts:
            self.counts[a] = Counter(a), len(" ".join(set(a.split())))
        return self.counts[a]

    def at_most(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        (x, n), (y, w) = self._count(a), self._count(b)
        common = sum(min(k, y[ch]) for ch, k in x.items() if ch in y)
        return 2 * common / (min(n, w) + common)


def _likeness(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            known: dict[tuple[str, str], float | None] = {}
            yield pd.Series([known[p] if p in known else known.setdefault(p, name_likeness(*p)) for p in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def title_likeness(a: Column, b: Column) -> Column:
    """0 to 1; null if either is blank."""
    return _likeness(normalize_key(a), normalize_key(b))


def location_likeness(a: Column, b: Column) -> Column:
    return _likeness(normalize_location(a), normalize_location(b))


def date_proximity(a: Column, b: Column) -> Column:
    gap = F.abs(F.date_diff(a, b))
    return F.when(gap == 0, 1.0).when(gap <= 1, 0.85).when(gap <= 3, 0.55).when(gap <= 7, 0.25).when(gap.isNotNull(), 0.0)


def states_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(location_state(a) != location_state(b), F.lit(False))


def score(day: Column, place: Column, name: Column, same_image: Column, conflict: Column) -> Column:
    """0 to 1 from the likeness of dates, places and titles: a mean of what is there, as missing parts are left out and the weights of the others shared anew."""
    parts = list(zip((day, place, name), WEIGHTS, strict=True))
    total = sum(F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts)
    mean = sum(F.coalesce(p, F.lit(0.0)) * w for p, w in parts) / F.nullif(total, F.lit(0.0))
    mean = F.when((day >= 0.85) & (place >= 0.85), F.greatest(mean, F.lit(SAME_DAY_AND_PLACE))).otherwise(mean)
    return F.when(same_image, F.when(day == 0.0, 0.0).otherwise(1.0)).when((day == 0.0) | conflict, 0.0).otherwise(F.round(F.coalesce(mean, F.lit(0.0)), 3))


def pair_score(gap: int | None, place: float | None, name: float | None, same_image: bool, conflict: bool) -> float:
    """score for one pair of rows; gap: days between them, None where a date is missing."""
    day = None if gap is None else next((s for most, s in ((0, 1.0), (1, 0.85), (POSSIBLE_GAP, 0.55), (NO_GAP, 0.25)) if gap <= most), 0.0)
    if same_image or day == 0.0 or conflict:
        return 1.0 if same_image and day != 0.0 else 0.0
    there = [(part, w) for part, w in zip((day, place, name), WEIGHTS, strict=True) if part is not None]
    if not there:
        return 0.0
    mean = sum(part * w for part, w in there) / sum(w for _, w in there)
    return round(max(mean, SAME_DAY_AND_PLACE) if (day or 0) >= 0.85 and (place or 0) >= 0.85 else mean, 3)


def similarity(a: str, b: str) -> Column:
    """The score of two record structs named a and b: start_date, location, title, flyer_phash."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    same_image = F.coalesce((x("flyer_phash") == y("flyer_phash")) & (x("flyer_phash") != ""), F.lit(False))
    return score(date_proximity(x("start_date"), y("start_date")), location_likeness(x("location"), y("location")), title_likeness(x("title"), y("title")),
                 same_image, states_conflict(x("location"), y("location")))


def edit_likeness(a: Column, b: Column) -> Column:
    """A likeness that SQL has too: one less the edit distance's share of the longer key; null if either is blank."""
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def edit_distance(a: str, b: str) -> int:
    """Edits that make b of a, with one bit per character of a for where a column of the table of distances rises or falls."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    if not a:
        return len(b)
    full, last, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rise, fall = full, 0
    for ch in b:
        hit = places.get(ch, 0)
        level = (((hit & rise) + rise) ^ rise) | hit
        up, down = (fall | ~(level | rise)) & full, rise & level
        out += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise, fall = (down | ~(hit | fall | up)) & full, up & (hit | fall)
    return out


def edit_share(a: str, b: str) -> float | None:
    """edit_likeness of two keys."""
    return 1 - edit_distance(a, b) / max(len(a), len(b)) if a and b else None


def key_likeness(a: Column, b: Column) -> Column:
    """Likeness of two keys by common subsequences and sets of words."""
    return _likeness(a, b)
