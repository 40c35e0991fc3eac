"""The inbox: images dropped into a folder with notes beside them, and lists of pasted links. Confidence is in hundredths."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import find_dates

#: Kinds of image file.
IMAGE_KINDS = "jpe?g|png|webp|gif|bmp|tiff?"
#: Field of a note -> field of a record, in the order in which they are said to be typed by hand.
NOTE_FIELDS = {"title": "title", "date": "start_date", "end": "end_date", "location": "location", "tribe": "tribe", "details": "details"}
RAW_CHARS = 3000


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def note_fields(text: Column) -> Column:
    """map of a note's ``key: value`` lines: keys in small letters, the last of a key, none without a value."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.locate(":", x) + 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: (p.k != "") & (p.v != ""))
    keys = F.transform(pairs, lambda p: p.k)
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), p.k)))


def from_images(files: DataFrame, notes: DataFrame, as_of: dt.date) -> DataFrame:
    """files: path; notes: path, text. A record per image, with the fields of the note of the same stem if there is one.

    A title made of the file's name is provisional. The end of a range in ``date`` fills ``end`` unless that is typed too. Other files give nothing; an image is
    met by one note only (the smallest path). Bytes aren't read.
    """
    name = _file_name(F.col("path"))
    images = files.where(name.rlike(rf"(?i)^[^.].*\.(?:{IMAGE_KINDS})$")).select("path", _stem(F.col("path")).alias("_stem")).distinct()
    texts = notes.where(F.col("path").rlike(r"\.txt$")).groupBy(_stem(F.col("path")).alias("_stem")).agg(F.min_by("text", "path").alias("_note"))
    rows = images.join(texts, "_stem", "left").withColumn("_f", note_fields(F.coalesce("_note", F.lit(""))))
    f = lambda k: F.try_element_at("_f", F.lit(k))
    rows = rows.withColumn("_d", find_dates(f("date"), as_of)).withColumn("_end", F.coalesce(T.iso_prefix_date(f("end")), F.when(f("end").isNull(), F.col("_d.end"))))
    there = {"date": F.col("_d.start").isNotNull(), "end": F.col("_end").isNotNull()}
    manual = F.array_compact(F.array(*[F.when(there.get(k, f(k).isNotNull()), F.lit(c)) for k, c in NOTE_FIELDS.items()]))
    return rows.select(
        F.coalesce(f("title"), F.translate(_file_name(F.col("_stem")), "_-", "  ")).alias("title"), f("title").isNull().alias("title_provisional"),
        F.col("_d.start").alias("start_date"), F.col("_end").alias("end_date"), f("location").alias("location"), f("tribe").alias("tribe"), f("details").alias("details"),
        F.coalesce(f("flyer_url"), F.concat(F.lit("local://"), F.regexp_replace("path", "^[a-z]+:/*", "/"))).alias("flyer_url"),
        F.coalesce(f("url"), F.concat(F.lit("local://"), _file_name(F.col("path")))).alias("source_url"),
        F.lit("manual").alias("extraction"), F.lit(40).alias("confidence"), manual.alias("manual_fields"),
    )


def from_links(lines: DataFrame, pages: DataFrame, as_of: dt.date) -> DataFrame:
    """lines: line (``url`` or ``url note``); pages: url, html, of what was fetched. A record per line that isn't blank or a comment.

    An image is a record by itself, a page's text is looked through, and a page that wasn't fetched leaves a placeholder with a warning. A note is the title, and for an
    image also the details. Repeated lines are records of their own.
    """
    line = F.trim("line")
    rows = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select(F.substring_index(line, " ", 1).alias("url"), line.alias("_line"))
    rows = rows.withColumn("_note", F.nullif(F.trim(F.substr("_line", F.length("url") + 1)), F.lit(""))).drop("_line")
    is_image = F.substring_index("url", "?", 1).rlike(rf"(?i)[^/.]\.(?:{IMAGE_KINDS})$")
    none = F.lit(None).cast("string")
    manual = [F.lit("manual").alias("extraction")]

    images = rows.where(is_image).select(
        F.coalesce("_note", F.lit("Flyer from pasted link")).alias("title"), none.cast("date").alias("start_date"), none.cast("date").alias("end_date"), none.alias("location"), none.alias("tribe"),
        F.col("_note").alias("details"), F.col("url").alias("flyer_url"), F.col("url").alias("source_url"), *manual, F.lit(40).alias("confidence"), none.alias("raw_text"),
        F.array().cast("array<string>").alias("warnings"), F.when(F.col("_note").isNotNull(), F.array(F.lit("title"), F.lit("details"))).otherwise(F.array().cast("array<string>")).alias("manual_fields"),
    )
    fetched = pages.where("html != ''").groupBy("url").agg(F.min("html").alias("html"))
    looked = rows.where(~is_image).join(fetched, "url", "left").withColumn("_text", F.regexp_replace(F.regexp_replace("html", "<[^>]+>", "\n"), "\n{2,}", "\n"))
    looked = looked.withColumn("_d", find_dates(F.col("_text"), as_of)).withColumn("_read", F.col("html").isNotNull())
    text, read = F.col("_text"), F.col("_read")
    others = looked.select(
        F.coalesce("_note", F.when(read, T.guess_title(text)), "url").alias("title"), F.col("_d.start").alias("start_date"), F.col("_d.end").alias("end_date"),
        F.when(read, T.find_location(text)).alias("location"), F.when(read, T.find_tribe(text)).alias("tribe"),
        F.when(~read, F.lit("Pasted link; page could not be read automatically.")).alias("details"), none.alias("flyer_url"), F.col("url").alias("source_url"), *manual,
        F.when(read, 35).otherwise(15).alias("confidence"), F.substr(text, F.lit(1), F.lit(RAW_CHARS)).alias("raw_text"),
        F.when(read, F.coalesce("_d.warnings", F.array().cast("array<string>"))).otherwise(F.array(F.lit("page could not be fetched - fill in by hand"))).alias("warnings"),
        F.array().cast("array<string>").alias("manual_fields"),
    )
    return images.unionByName(others)


def scan(spark: SparkSession, folder: str, pages: DataFrame, as_of: dt.date) -> DataFrame:
    """The records of a folder's images and of its links.txt or urls.txt. Folders in it, and files that begin with a dot or an underscore, are left out."""
    files = spark.read.format("binaryFile").load(folder).select("path")  # the bytes aren't asked for
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    is_list = F.lower(_file_name(F.col("path"))).isin("links.txt", "urls.txt")
    lines = texts.where(is_list).select(F.explode(F.split("text", r"\r\n|[\n\r]")).alias("line"))
    # both readers may spell a folder's scheme differently
    plain = F.regexp_replace("path", "^file:/+", "/")
    return from_images(files.withColumn("path", plain), texts.where(~is_list).withColumn("path", plain), as_of).unionByName(from_links(lines, pages, as_of), allowMissingColumns=True)
