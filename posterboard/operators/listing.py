"""The listing: moderation, upcoming and past, search, pages, the month's calendar, and the check of a submission."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE_ROWS = 3
HIDE_AT = 3


def visible(listings: DataFrame, hide_at: int = HIDE_AT) -> DataFrame:
    """Listings with fewer reports than hide_at; none counts as 0."""
    return listings.where(F.coalesce("report_count", F.lit(0)) < hide_at)


def upcoming(listings: DataFrame, as_of: dt.date) -> DataFrame:
    return listings.where(F.col("start_date") >= F.lit(as_of))


def past(listings: DataFrame, as_of: dt.date) -> DataFrame:
    """Also those without a date."""
    return listings.where(F.col("start_date").isNull() | (F.col("start_date") < F.lit(as_of)))


def search(rows: DataFrame, query: str, columns=("title", "location", "tribe", "details")) -> DataFrame:
    """Rows with the query in any column, case apart; an empty query keeps all. No wildcards."""
    q = query.strip().lower()
    if not q:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    return rows.where(hit)


def order(which: str) -> list[Column]:
    """The total order of a view: upcoming by date, past the other way round, admin the newest first; undated rows come last in each."""
    start, created = F.col("start_date"), F.col("created_at")
    return {
        "upcoming": [start.asc_nulls_last(), F.col("id").asc()], "past": [start.desc_nulls_last(), F.col("id").desc()], "admin": [created.desc_nulls_last(), F.col("id").desc()],
    }[which]


def ordered(rows: DataFrame, which: str) -> DataFrame:
    return rows.orderBy(*order(which))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the columns of order (ascending, nulls first; further ties go by the other columns), all columns. Partial minima come before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_row")
    return rows.groupBy(*keys).agg(least).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def page(rows: DataFrame, number: int, order: list[Column], size: int = PAGE_ROWS) -> DataFrame:
    """Page ``number`` (from 1) of rows in the given total order, as a limit and an offset: only the first pages' rows are ever sorted out."""
    return rows.orderBy(*order).limit(number * size).offset((number - 1) * size)


def page_numbers(rows: DataFrame, by: list[str], order: list[Column], size: int = PAGE_ROWS) -> DataFrame:
    """Adds page, the page on which each row stands within its group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("page", F.ceil(rank / size).cast("int"))


def count_text(rows: DataFrame, kind: str) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), F.concat(n.cast("string"), F.lit(f" {kind} event"), F.when(n == 1, "").otherwise("s")).alias("label"))


def calendar_days(listings: DataFrame, month: dt.date) -> DataFrame:
    """day, n, ids for each day of the month with listings; ids ascending. A range that ends before it starts has no days.

    Days are cut to the month before they are made, so a very long event makes 31 rows at most.
    """
    first = F.lit(month.replace(day=1))
    rows = listings.withColumn("last", F.coalesce("end_date", "start_date")).where(F.col("last") >= F.col("start_date"))
    rows = rows.withColumns({"a": F.greatest("start_date", first), "b": F.least("last", F.last_day(first))}).where("a <= b")
    days = rows.select("id", F.explode(F.sequence("a", "b")).alias("day"))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def month_grid(day: Column) -> Column:
    """struct<lead, days>: empty cells before the first of the month (weeks start on Sunday), days in the month."""
    return F.struct((F.dayofweek(F.trunc(day, "month")) - 1).alias("lead"), F.day(F.last_day(day)).alias("days"))


def admin_view(listings: DataFrame, which: str) -> DataFrame:
    """pending, reported, approved or all; null is not approved."""
    approved = F.coalesce("approved", F.lit(False))
    condition = {"pending": ~approved, "reported": F.coalesce("report_count", F.lit(0)) > 0, "approved": approved, "all": F.lit(True)}[which]
    return listings.where(condition)


def form_errors(rows: DataFrame) -> DataFrame:
    """Adds errors array<string> of submitted forms."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    checks = [
        (blank("title"), "title is missing"), (F.col("start_date").isNull(), "start date is missing"), (blank("location"), "location is missing"),
        (F.col("end_date") < F.col("start_date"), "ends before it starts"),
        (~blank("flyer_url") & ~F.col("flyer_url").rlike(r"(?i)^https://[^/\s]+/\S+"), "flyer is no https address with a path"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(c, m) for c, m in checks])))


#: Characters of a window by which texts are looked up.
WINDOW = 5


def _windows(text: Column) -> Column:
    """The distinct windows of a text; null if it is shorter than one."""
    places = F.sequence(F.lit(1), F.length(text) - WINDOW + 1)
    return F.when(F.length(text) >= WINDOW, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(WINDOW)))))


def containing(asked: DataFrame, there: DataFrame) -> DataFrame:
    """asked: start_date, wanted; there: start_date, text. The distinct start_date, wanted, text where the text holds what is wanted.

    What is wanted is looked up by that of its windows that the fewest texts of its day have, so a day's texts aren't all compared; what is shorter than a window is compared with all of them.
    No side is broadcast: a plan doesn't know how many windows a text has.
    """
    asked, there = asked.dropna().distinct(), there.dropna().distinct()
    merged = lambda l, r, on: l.hint("merge").join(r.hint("merge"), on)
    # the outer form, else a filter on all windows is pushed under the explode
    held = there.withColumn("window", F.explode_outer(_windows(F.col("text")))).where("window IS NOT NULL")
    counts = held.groupBy("start_date", "window").agg(F.count(F.lit(1)).alias("n"))
    own = asked.withColumn("window", F.explode_outer(_windows(F.col("wanted")))).where("window IS NOT NULL")
    rarest = merged(own, counts, ["start_date", "window"]).groupBy("start_date", "wanted").agg(F.min_by("window", F.struct("n", "window")).alias("window"))
    long = merged(rarest, held, ["start_date", "window"])
    short = merged(asked.where(F.length("wanted") < WINDOW), there, ["start_date"])
    both = long.select("start_date", "wanted", "text").unionByName(short.select("start_date", "wanted", "text"))
    return both.where(F.contains("text", "wanted"))


def _matching(asked: DataFrame, there: DataFrame) -> DataFrame:
    """As containing, for patterns with wildcards: the distinct ones of a day against its distinct texts."""
    asked, there = asked.dropna().distinct(), there.dropna().distinct()
    return asked.hint("merge").join(there.hint("merge"), "start_date").where(F.expr("text LIKE concat('%', wanted, '%')"))


def likely_duplicates(submitted: DataFrame, listings: DataFrame, raw: bool = False) -> DataFrame:
    """sub_id, id of listings on the submission's day whose title or location holds the submission's, case apart.

    With raw, % and _ of the submission are wildcards. Texts meet before rows do: each distinct text of a day is compared once. A pair by its location counts only if the titles don't make it too, so pairs needn't be
    gathered to be told apart, but for those of ids that stand in several rows.
    """
    holds = (lambda text, wanted: F.like(text, F.concat(F.lit("%"), wanted, F.lit("%")))) if raw else F.contains
    asked = submitted.select("sub_id", "start_date", F.lower("title").alias("w_title"), F.lower("location").alias("w_location")).where("start_date IS NOT NULL").distinct()
    there = listings.select("id", "start_date", F.lower("title").alias("t_title"), F.lower("location").alias("t_location")).where("start_date IS NOT NULL").distinct()
    texts = {}
    for c in ("title", "location"):
        texts[c] = (_matching if raw else containing)(asked.select("start_date", F.col(f"w_{c}").alias("wanted")), there.select("start_date", F.col(f"t_{c}").alias("text")))

    def rows(l: DataFrame, r: DataFrame) -> DataFrame:
        by = {}
        for c, found in texts.items():
            mine = l.hint("merge").join(found.withColumnsRenamed({"wanted": f"w_{c}", "text": f"t_{c}"}).hint("merge"), ["start_date", f"w_{c}"])
            other = {"title": "location", "location": "title"}[c]
            by[c] = mine.hint("merge").join(r.select("id", "start_date", f"t_{c}", F.col(f"t_{other}")).hint("merge"), ["start_date", f"t_{c}"])
        also = by["location"].where(~F.coalesce(holds(F.col("t_title"), F.col("w_title")), F.lit(False)))
        return by["title"].select("sub_id", "id").unionByName(also.select("sub_id", "id"))

    def apart(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose key is theirs alone, and the others. A null key is a key, too, and never alone."""
        often = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
        alone = df.where(F.col(key).isNotNull()).join(often, key, "left_anti")
        return alone, df.join(often, key, "left_semi").unionByName(df.where(F.col(key).isNull()))

    (a, more_a), (t, more_t) = apart(asked, "sub_id"), apart(there, "id")
    return rows(a, t).unionByName(rows(more_a, there).unionByName(rows(a, more_t)).distinct())


def mark_reported(listings: DataFrame, reported: DataFrame) -> DataFrame:
    """Adds reported_by_me; reported: id, one client's reports."""
    mine = reported.select("id").distinct().withColumn("reported_by_me", F.lit(True))
    return listings.join(mine, "id", "left").withColumn("reported_by_me", F.coalesce("reported_by_me", F.lit(False)))


def review_state(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds state to rows (id): the latest of decisions (id, state, decided_at); pending where there is none, or one that isn't known. Decisions on rows that are gone are ignored."""
    known = decisions.where(F.col("state").isin("approved", "rejected", "pending")).groupBy("id").agg(F.max_by("state", F.struct("decided_at", "state")).alias("_state"))
    return rows.join(known, "id", "left").withColumn("state", F.coalesce("_state", F.lit("pending"))).drop("_state").select(*[c for c in rows.columns if c != "state"], "state")


def review_tally(decisions: DataFrame) -> DataFrame:
    """decisions: id, state. Counts of pending, approved, rejected; an unknown state is pending."""
    state = F.when(F.col("state").isin("approved", "rejected"), F.col("state")).otherwise("pending")
    return decisions.agg(*[F.count_if(state == s).alias(s) for s in ("pending", "approved", "rejected")])
