"""Greedy collapse of duplicates inside a batch, without a task that holds them all.

Rows are gone through by rank: each joins the kept row that it is most like, if that is CERTAIN, or is kept; a kept row's title and place may grow by what joins it. So a row's fate depends on rows of higher rank
only, and the outcome is the one assignment that agrees with itself. It is found by blocks of a bounded number of rows: each block goes through its own rows in order, beside the kept rows of other blocks that
could be like one of its own, in the forms that they had, and what other blocks' rows did to its own, both as of the round before. A round in which nothing changes has the outcome. However rows are dealt into blocks, it is the same;
blocks of neighbouring days only make the rounds few.

What other blocks a kept row goes to is an equal join on keys: a place, or a title, that is alike and a day next to it, the same image, or the same day where nothing can be compared.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy
from ..functions.text import location_state, normalize_key, normalize_location
from ..session import ensure_checkpoints
from .alike import alike_pairs

#: Rows of a block, about; and the blocks that share a task.
BLOCK_ROWS = 4096
#: A title replaces another if it is longer by more than so many characters.
LONGER = 8
#: A row of the run through a block. role: own, seen (a form of another block's kept row), joined (another block's row that joined an own one); after it: row and form.
EVENT = "role string, id long, into long, into_block long, c long, f long, o long, day int, title string, chars int, place string, state string, image string, block long"
RANK = ("c", "f", "o")
#: Likeness under which no pair of rows can be CERTAIN: see reach.
LEAST_PLACE_SAME_DAY, LEAST_PLACE = 0.66, 0.81
LEAST_TITLE_SAME_DAY, LEAST_TITLE, LEAST_TITLE_WITH_PLACE = 0.7185, 0.895, 0.93


def rank_columns(rows: DataFrame) -> DataFrame:
    """Adds c, f, o: higher confidence first, then more filled fields, then arrival."""
    filled = sum(F.when(F.coalesce(F.col(x).cast("string"), F.lit("")) != "", 1).otherwise(0) for x in ("end_date", "tribe", "details", "flyer_url"))
    return rows.withColumns({"c": -F.coalesce("confidence", F.lit(0)).cast("long"), "f": -filled.cast("long"), "o": F.col("ordinal").cast("long")})


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows: EVENT without block. Adds block: neighbouring days up to twice BLOCK_ROWS rows; more rows of one day, or without one, are dealt by place, and those of one place by id."""
    per_day = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # a row for each distinct day
    days = per_day.withColumn("span", F.floor(F.coalesce(upto, F.lit(0)) / BLOCK_ROWS)).withColumn("span", F.when(F.col("day").isNull(), -1).otherwise(F.col("span")))
    spans = days.groupBy("span").agg(F.ceil(F.sum("n") / (2 * BLOCK_ROWS)).alias("parts"))
    days = days.join(spans, "span").select(F.col("day").alias("_day"), "span", "parts")
    rows = rows.join(days, F.col("day").eqNullSafe(F.col("_day"))).drop("_day").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")))
    sizes = rows.groupBy("span", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_ROWS)).alias("deals"))
    rows = rows.join(sizes, ["span", "part"]).withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")))
    # pandas has a column with nulls as doubles, so numbers of blocks stay under 2 ** 53; blocks of one number would be one block
    return rows.withColumn("block", F.pmod(F.xxhash64("span", "part", "deal"), F.lit(1 << 52))).drop("span", "part", "deal", "parts", "deals")


#: Days of a join key: any row, and a row without a day.
_ANY_DAY, _NO_DAY = -(10**9), -(10**9) - 1


def _key(kind: str, *parts) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def reach(rows: DataFrame) -> DataFrame:
    """block, key: the keys under which a kept row would concern a block.

    Scores of CERTAIN need days within one of each other or a day missing (or one image). Rows of one day in two blocks are there only where a day is dealt out; those need, with both places, a place of 0.72 or a title
    of 0.93, and with one place a title of 0.7185. Others need a place of 0.81, or with one place a title of 0.895. With neither to compare, rows of one day meet.
    """
    beside = F.when(F.col("day").isNull(), F.array(F.lit(_ANY_DAY))).otherwise(F.array(F.col("day") - 1, F.col("day") + 1, F.lit(_NO_DAY)))
    dealt = rows.where("day IS NOT NULL").groupBy("day").agg(F.count_distinct("block").alias("n")).where("n > 1").select("day")
    shared = rows.join(dealt, "day", "left_semi").select("block", F.col("day").alias("near"), "place", "title").distinct()
    own = rows.select("block", "place", "title", F.explode(beside).alias("near")).distinct()
    key = lambda df, c: df.select(F.col(c).alias("key"))
    both_ways = lambda df: df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    places = alike_pairs(key(rows, "place"), key(rows, "place"), LEAST_PLACE).select("a", "b")
    titles = both_ways(alike_pairs(key(rows.where("place = ''"), "title"), key(rows, "title"), LEAST_TITLE)).distinct()
    places_here = alike_pairs(key(shared, "place"), key(shared, "place"), 0.72).select("a", "b")
    titles_here = both_ways(alike_pairs(key(shared.where("place = ''"), "title"), key(shared, "title"), LEAST_TITLE_SAME_DAY))
    titles_here = titles_here.unionByName(alike_pairs(key(shared, "title"), key(shared, "title"), LEAST_TITLE_WITH_PLACE).select("a", "b")).distinct()
    to = lambda kind, df, c, pairs: df.join(pairs.withColumnRenamed("a", c), c).select("block", _key(kind, "near", "b").alias("key"))
    by_place = to("p", own, "place", places).unionByName(to("p", shared, "place", places_here))
    by_title = to("t", own, "title", titles).unionByName(to("t", shared, "title", titles_here))
    image = rows.where("image IS NOT NULL").select("block", _key("i", "image").alias("key"))
    no_place, no_title = F.col("place") == "", F.col("title") == ""
    lacks = F.array_compact(F.array(F.lit("both"), F.when(no_place, "no title"), F.when(no_title, "no place"), F.when(no_place & no_title, "any")))
    bare_day = rows.where("day IS NOT NULL").select("block", "day", F.explode(lacks).alias("lacks")).select("block", _key("d", "day", "lacks").alias("key"))
    return by_place.unionByName(by_title).unionByName(image).unionByName(bare_day).distinct()


def _keys_of_forms() -> Column:
    """The keys of a kept row's form, which meet those of reach."""
    day, no_place, no_title = F.col("day"), F.col("place") == "", F.col("title") == ""
    own = F.coalesce(day, F.lit(_NO_DAY))
    return F.array_compact(F.array(
        *[F.when(~no_place, _key("p", d, "place")) for d in (own, F.lit(_ANY_DAY))], *[F.when(~no_title, _key("t", d, "title")) for d in (own, F.lit(_ANY_DAY))],
        F.when(F.col("image").isNotNull(), _key("i", "image")), F.when(day.isNotNull() & no_place & no_title, _key("d", "day", F.lit("both"))), F.when(day.isNotNull() & no_title, _key("d", "day", F.lit("no title"))),
        F.when(day.isNotNull() & no_place, _key("d", "day", F.lit("no place"))), F.when(day.isNotNull(), _key("d", "day", F.lit("any"))),
    ))


class _Kept:
    """Kept rows of a block and those seen in others, found by day, place and image."""

    def __init__(self):
        self.rows: dict[int, dict] = {}
        self.by_day: dict[object, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.by_image: dict[str, list[int]] = defaultdict(list)
        self.like = fuzzy.Likeness()
        self.places: dict[str, dict[str, float]] = {}

    def put(self, e: dict) -> None:
        if e["place"]:
            self._alike_places(e["place"])
        self.rows[e["id"]] = e
        self.by_day[e["day"]][e["place"]].append(e["id"])
        if e["image"]:
            self.by_image[e["image"]].append(e["id"])

    def reshape(self, k: dict, e: dict) -> bool:
        """k takes what a row that joins it has more of; True if that is something."""
        longer, place = e["chars"] > k["chars"] + LONGER, not k["place"] and bool(e["place"])
        if longer:
            k["title"], k["chars"] = e["title"], e["chars"]
        if place:
            self.by_day[k["day"]][""].remove(k["id"])
            self.by_day[k["day"]][e["place"]].append(k["id"])
            self._alike_places(e["place"])
            k["place"], k["state"] = e["place"], e["state"]
        return longer or place

    def _near(self, e: dict):
        """Kept rows that can be CERTAIN, with the gap in days."""
        days = self.by_day if e["day"] is None else (e["day"] - 1, e["day"], e["day"] + 1, None)
        for d in days:
            gap = None if d is None or e["day"] is None else abs(d - e["day"])
            if d not in self.by_day:
                continue
            bucket, least = self.by_day[d], LEAST_PLACE_SAME_DAY if gap == 0 else LEAST_PLACE
            near = self._alike_places(e["place"]) if e["place"] else None
            for place in [x for x in near if x in bucket] if near and len(near) < len(bucket) else list(bucket):
                p = near.get(place, 0.0) if near and place else None
                if p is None or p >= least:
                    for i in bucket[place]:
                        yield self.rows[i], gap, p

    def _alike_places(self, place: str) -> dict[str, float]:
        """Places of the block that are alike this one, and no place; each pair is compared once."""
        if place not in self.places:
            self.places[place] = {"": 0.0, place: 1.0}
            for other, near in self.places.items():
                if other != place and self.like.at_most(place, other) >= LEAST_PLACE_SAME_DAY and (p := self.like(place, other)) >= LEAST_PLACE_SAME_DAY:
                    self.places[place][other] = near[place] = p
        return self.places[place]

    def best(self, e: dict) -> dict | None:
        """The kept row that e is most like, of equals the one of the highest rank; None if none is CERTAIN."""
        found, top = None, (fuzzy.CERTAIN, ())
        for k, gap, p in self._near(e):
            if e["image"] and e["image"] == k["image"]:
                continue  # they come by their image
            t, both = None, e["title"] and k["title"]
            conflict = bool(e["state"] and k["state"] and e["state"] != k["state"])
            if both:
                if fuzzy.pair_score(gap, p, self.like.at_most(e["title"], k["title"]), False, conflict) < top[0]:
                    continue  # even so it would be no better
                t = self.like(e["title"], k["title"])
            s = fuzzy.pair_score(gap, p, t, False, conflict)
            if s > top[0] or s == top[0] and (found is None or k["rank"] < found["rank"]):
                found, top = k, (s, ())
        for i in self.by_image.get(e["image"], ()) if e["image"] else ():
            k = self.rows[i]
            gap = None if k["day"] is None or e["day"] is None else abs(k["day"] - e["day"])
            s = fuzzy.pair_score(gap, None, None, True, False)
            if s > top[0] or s == top[0] and (found is None or k["rank"] < found["rank"]):
                found, top = k, (s, ())
        return found


def _through(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block in the order of ranks: what became of its rows, and the forms of those that are kept."""
    events = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
    for e in events:
        e["rank"] = (e["c"], e["f"], e["o"])
    events.sort(key=lambda e: (e["rank"], e["role"] != "own"))  # a row comes before what it makes of another
    kept, out = _Kept(), []

    def form(k: dict, at: dict) -> None:
        out.append({**k, "role": "form", "into": None, "into_block": None, "c": at["c"], "f": at["f"], "o": at["o"]})

    for e in events:
        if e["role"] == "own":
            k = kept.best(e)
            out.append({**e, "role": "row", "into": k and k["id"], "into_block": k and (k["into_block"] if k["role"] == "seen" else e["block"])})
            if k is None:
                kept.put(e)
                form(e, e)
            elif k["role"] == "own" and kept.reshape(k, e):
                form(k, e)
        elif e["role"] == "joined":
            k = kept.rows.get(e["id"])
            if k is not None and kept.reshape(k, e):
                form(k, e)
        elif (k := kept.rows.get(e["id"])) is None:
            kept.put(e)
        else:  # a later form of a row that was seen before
            kept.by_day[k["day"]][k["place"]].remove(k["id"])
            kept.by_day[k["day"]][e["place"]].append(k["id"])
            if e["place"]:
                kept._alike_places(e["place"])
            k.update({x: e[x] for x in ("title", "chars", "place", "state")})
    whole = {c: pd.array([r[c] for r in out], dtype="Int64") for c in ("id", "into", "into_block", "c", "f", "o", "block", "day", "chars")}
    return pd.DataFrame(out, columns=_COLUMNS).assign(**whole)


_COLUMNS = [x.split()[0] for x in EVENT.split(", ")]


def decide(rows: DataFrame) -> DataFrame:
    """rows: EVENT, without block, with the role own; id is distinct. Returns id, into (null if kept) and the rank."""
    ensure_checkpoints(rows.sparkSession)
    own = in_blocks(rows).select(*_COLUMNS).checkpoint()
    concern = reach(own).checkpoint()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as blocks are few bytes and much work
    through = lambda events: events.select(*_COLUMNS).repartition(parts, "block").groupBy("block").applyInPandas(_through, EVENT)
    state, before = through(own).checkpoint(), None
    while True:
        forms = state.where("role = 'form'")
        keys = forms.select("id", F.col("block").alias("home"), F.explode(_keys_of_forms()).alias("key")).distinct()
        there = keys.join(concern, "key").where("block != home").select("id", "block").distinct()
        seen = forms.drop("role", "into_block").withColumnRenamed("block", "into_block").join(there, "id").withColumn("role", F.lit("seen"))
        joined = state.where("role = 'row' AND into_block != block").drop("id", "block", "role").withColumnsRenamed({"into": "id", "into_block": "block"})
        joined = joined.withColumns({"role": F.lit("joined"), "into": F.lit(None).cast("long"), "into_block": F.lit(None).cast("long")})
        foreign = seen.select(*_COLUMNS).unionByName(joined.select(*_COLUMNS)).checkpoint()
        # a block says the same again if it hears the same, so only others are gone through
        heard = foreign.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*_COLUMNS).cast("decimal(38,0)")).alias("sum")).checkpoint()
        if before is None:
            changed = heard.select("block")
        else:
            old = before.select("block", F.col("n").alias("_n"), F.col("sum").alias("_sum"))
            changed = heard.join(old, "block", "full_outer").where("NOT (n <=> _n AND sum <=> _sum)").select("block")
        changed = changed.checkpoint()
        if changed.isEmpty():
            return state.where("role = 'row'").select("id", "into", *RANK)
        again = own.unionByName(foreign).join(changed, "block", "left_semi")
        state = state.join(changed, "block", "left_anti").select(*_COLUMNS).unionByName(through(again)).checkpoint()
        before = heard


def collapse(rows: DataFrame) -> DataFrame:
    """rows: the record columns, with distinct ordinals. Returns them with merged_into: null for kept rows, else the ordinal of the row that took this one in.

    A kept row gets what it lacks from the rows that it took in, in their order: fields, a longer title, their sources, the higher confidence, and a warning for each other address. Kept rows with one image on different
    days warn of each other. Null dates, places, titles and images are compared as far as they are there; an empty table gives no rows.
    """
    ranked = rank_columns(rows)
    day = F.date_diff("start_date", F.lit("1970-01-01").cast("date"))
    none = F.lit(None).cast("long")
    # keys are made once for each distinct text
    titles = ranked.select("title").distinct().select(F.col("title").alias("_t"), normalize_key(F.col("title")).alias("_title"))
    places = ranked.select("location").distinct().select(F.col("location").alias("_p"), normalize_location(F.col("location")).alias("_place"), location_state(F.col("location")).alias("_state"))
    keyed = ranked.select("ordinal", *RANK, "start_date", "title", "location", "flyer_phash").join(titles, F.col("title").eqNullSafe(F.col("_t"))).join(places, F.col("location").eqNullSafe(F.col("_p")))
    fate = decide(keyed.select(
        F.lit("own").alias("role"), F.col("ordinal").cast("long").alias("id"), none.alias("into"), none.alias("into_block"), *RANK, day.alias("day"), F.col("_title").alias("title"),
        F.length(F.coalesce("title", F.lit(""))).alias("chars"), F.col("_place").alias("place"), F.col("_state").alias("state"), F.nullif("flyer_phash", F.lit("")).alias("image"),
    ))
    ranked = ranked.join(fate.select(F.col("id").alias("ordinal"), F.col("into").alias("merged_into")), "ordinal").withColumn("rank", F.struct(*RANK)).drop(*RANK).checkpoint()
    kept, lost = ranked.where("merged_into IS NULL"), ranked.where("merged_into IS NOT NULL")
    return enrich_kept(kept, lost).select(*rows.columns, "merged_into").unionByName(lost.select(*rows.columns, "merged_into"))


FILLED = ("end_date", "location", "tribe", "details", "flyer_url", "raw_text")


def enrich_kept(kept: DataFrame, lost: DataFrame) -> DataFrame:
    """Kept rows with what the rows merged into them add; each of the parts is a sum that tasks can begin on their own."""
    there = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    first = lost.groupBy(F.col("merged_into").alias("ordinal")).agg(F.max("confidence").alias("_confidence"), *[F.min_by(c, F.when(there(c).isNotNull(), F.col("rank"))).alias(f"_{c}") for c in FILLED])
    # of titles of one length only the first can count, and of a source's rows the first
    order = F.array_sort(F.collect_list(F.struct("rank", "x")))
    titles = lost.where("title IS NOT NULL").groupBy("merged_into", F.length("title").alias("n")).agg(F.min("rank").alias("rank"), F.min_by("title", "rank").alias("x"))
    titles = titles.groupBy(F.col("merged_into").alias("ordinal")).agg(order.alias("_titles"))
    sources = lost.where("source != ''").groupBy("merged_into", F.col("source").alias("x")).agg(F.min("rank").alias("rank"))
    sources = sources.groupBy(F.col("merged_into").alias("ordinal")).agg(order.alias("_sources"))
    notes = _notes(kept, lost).groupBy("ordinal").agg(order.alias("_notes"))
    out = kept
    for part in (first, titles, sources, notes):
        out = out.join(part, "ordinal", "left")
    grown = lambda t, x: F.when(F.length(x["x"]) > F.length(F.coalesce(t, F.lit(""))) + LONGER, x["x"]).otherwise(t)
    also = lambda s, x: F.when(F.coalesce(s, F.lit("")) == "", x["x"]).when(F.contains(s, x["x"]), s).otherwise(F.concat(s, F.lit("+"), x["x"]))
    nothing = F.array().cast("array<struct<rank:struct<c:long,f:long,o:long>,x:string>>")
    fold = lambda start, parts, step: F.aggregate(F.coalesce(parts, nothing), start.cast("string"), step)
    return out.withColumns({
        **{c: F.coalesce(there(c), f"_{c}", c) for c in FILLED}, "title": fold(F.col("title"), "_titles", grown), "source": fold(F.col("source"), "_sources", also),
        "confidence": F.greatest(F.coalesce("confidence", F.lit(0)), F.coalesce("_confidence", F.lit(0))).cast(dict(kept.dtypes)["confidence"]),
        "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.transform(F.coalesce("_notes", nothing), lambda x: x["x"])),
    })


def _notes(kept: DataFrame, lost: DataFrame) -> DataFrame:
    """ordinal, rank, x: the warnings that a kept row gets, and when: at the rank of the row that gives cause."""
    addresses = lost.where("source_url != ''").select(F.col("merged_into").alias("ordinal"), "rank", F.col("source_url").alias("url"))
    addresses = addresses.join(kept.select("ordinal", F.col("source_url").alias("own")), "ordinal").where("own IS NULL OR own != url").select("ordinal", "rank", F.concat(F.lit("also listed at "), "url").alias("x"))
    pictured = kept.where("flyer_phash != ''").select("ordinal", "rank", "flyer_phash", "start_date")
    firsts = pictured.groupBy("flyer_phash").agg(F.min_by(F.struct(F.col("ordinal").alias("id"), F.col("start_date").alias("day")), "rank").alias("first"))
    twins = pictured.join(firsts, "flyer_phash").where("ordinal != first.id AND NOT start_date <=> first.day")
    text = lambda d: F.concat(F.lit("same flyer image as another event in this batch ("), F.coalesce(F.col(d).cast("string"), F.lit("None")), F.lit(") - check which date is right"))
    later = twins.select("ordinal", "rank", text("first.day").alias("x"))
    earlier = twins.select(F.col("first.id").alias("ordinal"), "rank", text("start_date").alias("x"))
    return addresses.unionByName(later).unionByName(earlier)
