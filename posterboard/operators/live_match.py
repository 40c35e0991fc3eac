"""The best row of the live table for each candidate: a search for one row each, bounded by what a pair can score at most. No pairs of rows are made.

Rows with the same day, title, place and state are one profile, and a candidate profile needs only the first live row of a profile (later start, then smaller id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.text import location_state, normalize_key, normalize_location
from ..session import ensure_checkpoints
from .alike import alike_pairs

#: Profiles of the right that a task compares at once; so many times that of the left, and of the right in all.
BLOCK, LEFT_BLOCKS, RIGHT_BLOCKS = 1_024, 4, 64
#: Likenesses that a task remembers.
MEMO = 1 << 20
#: Days of a cell; a candidate looks into the cells that its days up to POSSIBLE_GAP away fall into, two at most.
CELL_DAYS = 2 * fuzzy.POSSIBLE_GAP + 1
_BINS = 64
_LIKELY = round(fuzzy.LIKELY * 1000)
PROFILE = ["title", "place", "state"]


@dataclass(frozen=True)
class Measure:
    """A likeness of keys: of columns, of two keys, and the most that keys of given sizes with so many characters in common can have."""

    column: Callable[[Column, Column], Column]
    exact: Callable[[str, str], float | None]
    size: Callable[[str], int]
    at_most: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


#: Common subsequences and sets of words (see fuzzy.Likeness for the bound).
NAMES = Measure(fuzzy.key_likeness, fuzzy.name_likeness, lambda t: len(" ".join(set(t.split()))), lambda c, n, w: 2 * c / np.maximum(np.minimum(n, w) + c, 1))
#: Edit distance: what isn't in common takes an edit at least.
EDITS = Measure(fuzzy.edit_likeness, fuzzy.edit_share, len, lambda c, n, w: c / np.maximum(np.maximum(n, w), 1))


class _Keys:
    """The distinct keys of both sides of a block, what each pair can have at most, and the likenesses worked out so far, here and in the blocks before."""

    def __init__(self, left: pd.Series, right: pd.Series, measure: Measure, memo: dict[tuple[str, str], float]):
        self.memo = memo
        if len(memo) > MEMO:
            memo.clear()
        (self.l, a), (self.r, b) = pd.factorize(left), pd.factorize(right)
        self.a, self.b, self.exact = list(a), list(b), measure.exact
        x, y = self._letters(self.a), self._letters(self.b)
        common = np.zeros((len(self.a), len(self.b)), np.int32)
        for k in np.flatnonzero(x.any(0) & y.any(0)):
            common += np.minimum(x[:, k, None], y[None, :, k])
        n, w = (np.array([measure.size(t) for t in texts], np.int64) for texts in (self.a, self.b))
        self.most = np.minimum(measure.at_most(common, n[:, None], w[None, :]), 1.0)
        there = np.array([t != "" for t in self.a])[:, None] & np.array([t != "" for t in self.b])[None, :]
        self.most = np.where(there, self.most, np.nan)
        self.known = np.full(self.most.shape, -1.0)

    @staticmethod
    def _letters(texts: list[str]) -> np.ndarray:
        """Counts of characters, dealt into bins: keys share no more characters than counts."""
        out = np.zeros((len(texts), _BINS), np.int32)
        for i, t in enumerate(texts):
            out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % _BINS, minlength=_BINS)
        return out

    def bound(self) -> np.ndarray:
        """For all rows of the block; nan where a key is blank."""
        return self.most[self.l[:, None], self.r[None, :]]

    def at_most(self, i: int, j: int) -> float | None:
        most = self.most[self.l[i], self.r[j]]
        return None if np.isnan(most) else most

    def like(self, i: int, j: int) -> float | None:
        p = self.l[i], self.r[j]
        if np.isnan(self.most[p]):
            return None
        if self.known[p] < 0:
            self.known[p] = self._exact(*p)
        return self.known[p]

    def _exact(self, a: int, b: int) -> float:
        pair = self.a[a], self.b[b]
        found = self.memo.get(pair)
        if found is None:
            found = self.memo[pair] = self.exact(*pair)
        return found

    def row(self, i: int, some: np.ndarray) -> np.ndarray:
        """The likenesses of a row of the left and some of the right; nan where a key is blank."""
        a = self.l[i]
        known, most = self.known[a], self.most[a]
        for b in np.unique(self.r[some]):
            if known[b] < 0 and not np.isnan(most[b]):
                known[b] = self._exact(a, b)
        return np.where(np.isnan(most), np.nan, known)[self.r[some]]


def _mean(day: float, place: float | None, title: float | None) -> float:
    """The score before it is rounded, for rows that have a day, no image in common and no states that differ."""
    total = value = 0.0
    for part, weight in zip((day, place, title), fuzzy.WEIGHTS, strict=True):
        total += weight if part is not None else 0.0
        value += (part or 0.0) * weight
    mean = value / total
    return max(mean, fuzzy.SAME_DAY_AND_PLACE) if day >= 0.85 and (place or 0.0) >= 0.85 else mean


def _thousandths(mean: float) -> int:
    """Rounded as Spark rounds it: half up by the shortest digits."""
    return int(Decimal(repr(float(mean))).quantize(Decimal("0.001"), ROUND_HALF_UP).scaleb(3))


def _most(day: np.ndarray, place: np.ndarray, title: np.ndarray) -> np.ndarray:
    """Thousandths that scores are at most, by what their parts are at most; nan is a part that is blank."""
    total, value = np.full(day.shape, fuzzy.WEIGHTS[0]), day * fuzzy.WEIGHTS[0]
    for part, weight in ((place, fuzzy.WEIGHTS[1]), (title, fuzzy.WEIGHTS[2])):
        total += np.where(np.isnan(part), 0.0, weight)
        value += np.nan_to_num(part) * weight
    mean = value / total
    mean = np.where((day >= 0.85) & (np.nan_to_num(place) >= 0.85 - 1e-9), np.maximum(mean, fuzzy.SAME_DAY_AND_PLACE), mean)
    return np.floor(mean * 1000 + 0.5 + 1e-6).astype(np.int64)


def _nearness(gap: np.ndarray) -> np.ndarray:
    return np.select([gap == 0, gap <= 1, gap <= fuzzy.POSSIBLE_GAP], [1.0, 0.85, 0.55], 0.0)


#: What a pair of such days can score at most, with equal keys or blank ones.
_CAPS = {day: int(max(_most(np.array([day] * 4), np.array([1.0, np.nan] * 2), np.array([1.0, 1.0, np.nan, np.nan])))) for day in (1.0, 0.85, 0.55)}


def best_of_block(l: pd.DataFrame, r: pd.DataFrame, measure: Measure, floor: np.ndarray, memos: tuple[dict, dict]) -> list[tuple[int, int, int]]:
    """l: day, title, place, state; r: the same, id, flagged, by falling day, then id. Place in l, thousandths and place in r of the best likely row of r for each of l that has one over its floor, of those up to POSSIBLE_GAP days apart.

    Each row of l looks at those of r by falling bound, ties in their order, and stops at the first that can't be better than what it has. Its likenesses to the titles there, which are often few, are worked out
    before the bounds that it goes by; titles are as many as rows where all differ, and are then looked at one by one.
    """
    days, r_days = l["day"].to_numpy(), r["day"].to_numpy()
    apart_by = np.maximum(np.maximum(r_days.min() - days, days - r_days.max()), 0)
    cap = np.select([apart_by == 0, apart_by <= 1, apart_by <= fuzzy.POSSIBLE_GAP], [_CAPS[1.0], _CAPS[0.85], _CAPS[0.55]], -1)
    rows = np.flatnonzero(cap > floor)
    if not len(rows):
        return []
    l, floor = l.iloc[rows], floor[rows]
    titles, places = _Keys(l["title"], r["title"], measure, memos[0]), _Keys(l["place"], r["place"], measure, memos[1])
    day = _nearness(np.abs(l["day"].to_numpy()[:, None] - r_days[None, :]))
    a, b = l["state"].to_numpy()[:, None], r["state"].to_numpy()[None, :]
    apart = (day == 0) | ((a != b) & (a != "") & (b != ""))
    place = places.bound()
    most = np.where(apart, -1, _most(day, place, titles.bound()))
    found = []
    for i in np.flatnonzero(most.max(1) > floor):
        able = np.flatnonzero(most[i] > floor[i])
        few = len(able) > 32 and 8 * len(np.unique(titles.r[able])) <= len(able)
        bound = _most(day[i, able], place[i, able], titles.row(i, able)) if few else most[i, able]
        best, at = floor[i], -1
        for n in np.argsort(-bound, kind="stable"):
            j = able[n]
            if (bound[n], -j) < (best, -at):
                break
            title = titles.like(i, j)
            if not few and np.floor(_mean(day[i, j], places.at_most(i, j), title) * 1000 + 0.5 + 1e-6) < best:
                continue
            k = _thousandths(_mean(day[i, j], places.like(i, j), title))
            if (k, -j) > (best, -at) and k >= _LIKELY:
                best, at = k, j
        if at >= 0:
            found.append((int(rows[i]), int(best), int(at)))
    return found


_UNIT = ["cell", "at_l", "part_r"]
_FOUND = ["day", *PROFILE, "score", "r_day", "id", "flagged"]


def _through(batches: Iterator[pd.DataFrame], measure: Measure, block: int) -> Iterator[pd.DataFrame]:
    """Units in order: a block of the left, then rows of the right, which go by in blocks. What a row of the left has found is a floor for the blocks that follow."""
    memos: tuple[dict, dict] = ({}, {})
    unit, left, right, l = None, [], [], None
    best, hits = None, {}

    def meet() -> None:
        nonlocal l, best, right
        if l is None:
            l = pd.concat(left, ignore_index=True) if left else pd.DataFrame()
            best = np.full(len(l), _LIKELY - 1, np.int64)
        r, right = pd.concat(right, ignore_index=True), []
        if not len(l):
            return
        for start in range(0, len(r), block):
            some = r.iloc[start : start + block]
            for i, k, j in best_of_block(l, some, measure, best, memos):
                best[i] = k
                hits[i] = some.iloc[j]

    def done() -> pd.DataFrame | None:
        nonlocal left, right, l, hits
        if right:
            meet()
        out = None
        if hits:
            at = list(hits)
            out = l.iloc[at][["day", *PROFILE]].reset_index(drop=True).assign(
                score=best[at] / 1000, r_day=[int(h["day"]) for h in hits.values()], id=[h["id"] for h in hits.values()], flagged=[h["flagged"] for h in hits.values()])
        left, right, l, hits = [], [], None, {}
        return out

    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[[*_UNIT, "side"]].to_numpy()
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
        for start, end in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            *at, side = keys[start]
            if tuple(at) != unit:
                if (out := done()) is not None:
                    yield out[_FOUND]
                unit = tuple(at)
            (right if side else left).append(pdf.iloc[start:end])
            if side and sum(map(len, right)) >= block:
                meet()
    if (out := done()) is not None:
        yield out[_FOUND]


def _keyed(rows: DataFrame, *keep: str) -> DataFrame:
    """What a comparison needs of a row, made once, and for each distinct text once. Blank keys and states are '', a day is a number, or null."""
    state = F.coalesce(location_state(F.col("_location")), F.lit(""))
    rows = rows.select(*keep, F.unix_date("start_date").alias("day"), F.col("title").alias("_title"), F.col("location").alias("_location"), F.nullif("flyer_phash", F.lit("")).alias("image"))
    titles = rows.select("_title").distinct().select(F.col("_title").alias("_t"), normalize_key(F.col("_title")).alias("title"))
    places = rows.select("_location").distinct().select(F.col("_location").alias("_p"), normalize_location(F.col("_location")).alias("place"), state.alias("state"))
    rows = rows.join(titles, F.col("_title").eqNullSafe(F.col("_t"))).join(places, F.col("_location").eqNullSafe(F.col("_p")))
    return rows.select(*keep, "day", "title", "place", "state", "image")


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """The first live row of each group, as r: r_day, a smaller id is larger, id, flagged."""
    return rows.groupBy(*by).agg(F.max(F.struct(F.col("day").alias("r_day"), (-F.col("id")).alias("back"), "id", "flagged")).alias("r"))


def _scored(score: Column | float) -> Column:
    score = score if isinstance(score, Column) else F.lit(score)
    return F.struct(score.alias("score"), "r.r_day", "r.back", "r.id", "r.flagged").alias("m")


def _same_image(l: DataFrame, r: DataFrame) -> DataFrame:
    """fingerprint, m: by image, where the days are NO_GAP apart at most or one is missing. Each image and day asks once, and meets a row for each day."""
    asked = l.where("image IS NOT NULL").select("image", "day").distinct()
    days = F.explode(F.array_append(F.sequence(F.col("day") - fuzzy.NO_GAP, F.col("day") + fuzzy.NO_GAP), F.lit(None).cast("int"))).alias("near")
    there = r.where("image IS NOT NULL")
    by_day = _first(there.withColumn("near", F.col("day")), "image", "near")
    near = asked.where("day IS NOT NULL").select("image", "day", days).alias("a").join(by_day.alias("b"), (F.col("a.image") == F.col("b.image")) & F.col("a.near").eqNullSafe(F.col("b.near"))).select("a.image", "a.day", _scored(1.0))
    any_day = asked.where("day IS NULL").join(_first(there, "image"), "image").select("image", "day", _scored(1.0))
    best = near.unionByName(any_day).groupBy("image", "day").agg(F.max("m").alias("m")).withColumnsRenamed({"image": "b_image", "day": "b_day"})
    return l.join(best, (F.col("image") == F.col("b_image")) & F.col("day").eqNullSafe(F.col("b_day"))).select("fingerprint", "m")


def _near_days(l: DataFrame, r: DataFrame, measure: Measure, block: int) -> DataFrame:
    """fingerprint, m: of rows up to POSSIBLE_GAP days apart. The profiles of a cell of days are dealt into blocks of the left and parts of the right; each pair of them is a unit, which gives a row for a candidate profile at most."""
    gap, key = fuzzy.POSSIBLE_GAP, ["day", *PROFILE]
    cell_of = lambda day: F.floor(day / CELL_DAYS).cast("int")
    asked = l.where("day IS NOT NULL").select(*key).distinct().withColumn("cell", F.explode(F.array_distinct(F.array(cell_of(F.col("day") - gap), cell_of(F.col("day") + gap)))))
    there = _first(r.where("day IS NOT NULL"), *key).select(*key, "r.id", "r.flagged").withColumn("cell", cell_of(F.col("day")))
    parts = lambda rows, most, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    # a row for seven days: as dates have four digits for the year, 522 thousand rows at most
    cells = F.broadcast(parts(asked, LEFT_BLOCKS * block, "n_l").join(parts(there, RIGHT_BLOCKS * block, "n_r"), "cell"))
    kind = dict(r.dtypes)

    def dealt(rows: DataFrame, own: str, own_at: str, other: str, other_at: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*key), F.col(own)).cast("int").alias(own_at)
        return rows.join(cells, "cell").select(*rows.columns, at, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_at))

    columns = [*_UNIT, "side", *key, "id", "flagged"]
    # no nulls in numbers, which pandas would make doubles
    own = dealt(asked, "n_l", "at_l", "n_r", "part_r").withColumns({"side": F.lit(0), "id": F.lit(0).cast(kind["id"]), "flagged": F.lit(False)})
    units = own.select(*columns).unionByName(dealt(there, "n_r", "part_r", "n_l", "at_l").withColumn("side", F.lit(1)).select(*columns))
    # a stated number of partitions, as units are few bytes and much work; the order is the one that ties go by
    units = units.repartition(int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_UNIT).sortWithinPartitions(*_UNIT, "side", F.desc("day"), "id")
    found = units.mapInPandas(lambda batches: _through(batches, measure, block), f"day int, title string, place string, state string, score double, r_day int, id {kind['id']}, flagged boolean")
    best = found.select(*key, F.struct("score", "r_day", (-F.col("id")).alias("back"), "id", "flagged").alias("m")).groupBy(*key).agg(F.max("m").alias("m"))
    return l.join(best, key).select("fingerprint", "m")


def _undated(l: DataFrame, r: DataFrame, measure: Measure) -> DataFrame:
    """fingerprint, m: where a day is missing on one side. The score is then a mean of two likenesses, so one of them is LIKELY if the score is: profiles meet by an alike place or title."""
    asked, there = l.select(*PROFILE).distinct(), _first(r, *PROFILE)
    a, b = (df.withColumnsRenamed({c: f"{side}_{c}" for c in PROFILE}) for side, df in (("l", asked), ("r", there)))
    met = None
    for name in ("place", "title"):
        alike = alike_pairs(a.select(F.col(f"l_{name}").alias("key")), b.select(F.col(f"r_{name}").alias("key")), fuzzy.LIKELY - 0.001, measure.column)
        pairs = a.join(alike.select(F.col("a").alias(f"l_{name}"), F.col("b").alias(f"r_{name}")), f"l_{name}").join(b, f"r_{name}").select(*a.columns, *b.columns)
        met = pairs if met is None else met.unionByName(pairs)
    met = met.where("l_state = r_state OR l_state = '' OR r_state = ''").distinct()
    for name in ("place", "title"):
        x, y = f"l_{name}", f"r_{name}"
        # each distinct pair of keys is compared once
        met = met.join(met.select(x, y).distinct().withColumn(f"{name}_likeness", measure.column(F.col(x), F.col(y))), [x, y])
    score = fuzzy.score(F.lit(None).cast("double"), F.col("place_likeness"), F.col("title_likeness"), F.lit(False), F.lit(False))
    best = met.withColumn("score", score).where(F.col("score") >= fuzzy.LIKELY).select(*[F.col(f"l_{c}").alias(c) for c in PROFILE], _scored(F.col("score")))
    return l.join(best.groupBy(*PROFILE).agg(F.max("m").alias("m")), PROFILE).select("fingerprint", "m")


def best_live_match(candidates: DataFrame, live: DataFrame, measure: Measure = NAMES, block: int = BLOCK) -> DataFrame:
    """candidates: fingerprint, start_date, location, title, flyer_phash; live: id, flagged and the same. Returns fingerprint, verdict, id, score, flagged for each candidate.

    Ties go to the later start, then the smaller id; a live row without a date comes last. A match below LIKELY is no match: its id and score are null. Nulls and blanks count as missing; a
    pair of states that differ is no match unless the images are the same; repeated rows and empty tables are fine; other columns are ignored. A day with many rows is dealt into
    blocks: the work on it is still a product of its distinct profiles, less what the bounds spare, but no task holds more than a block of either side at once and no pair leaves one.
    """
    ensure_checkpoints(candidates.sparkSession)
    # keys are made once: several searches read them
    l, r = _keyed(candidates, "fingerprint").checkpoint(), _keyed(live, "id", "flagged").where("id IS NOT NULL").checkpoint()
    missing, dated = (lambda df: df.where("day IS NULL")), (lambda df: df.where("day IS NOT NULL"))
    found = _same_image(l, r).unionByName(_near_days(l, r, measure, block)).unionByName(_undated(missing(l), r, measure)).unionByName(_undated(dated(l), missing(r), measure))
    best = found.groupBy("fingerprint").agg(F.max("m").alias("m"))
    out = candidates.select("fingerprint").join(best, "fingerprint", "left")
    verdict = F.when(F.col("m.score") >= fuzzy.CERTAIN, "duplicate").when(F.col("m.score") >= fuzzy.LIKELY, "possible").otherwise("new")
    return out.select("fingerprint", verdict.alias("verdict"), "m.id", "m.score", "m.flagged")
