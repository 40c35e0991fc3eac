"""What earlier runs have seen: exact, by near-identical image, by date and place; and the keeping of that memory."""

from __future__ import annotations

import datetime as dt
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..schemas import LEDGER
from .near_hashes import near_hashes

NEAR_BITS = 12
KEEP_DAYS = 900
#: The file that names the version of a saved ledger that counts.
CURRENT = "CURRENT"


def unseen(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose fingerprint the ledger doesn't have."""
    return rows.join(ledger.select("fingerprint").distinct(), "fingerprint", "left_anti")


def unseen_key(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose match_key the ledger doesn't have; a key without date or place matches nothing."""
    known = ledger.where("match_key NOT LIKE '|%' AND match_key NOT LIKE '%|'").select("match_key").distinct()
    return rows.join(known, "match_key", "left_anti")


#: Bits of the bands of a hash of 64 digits: place among the 256, and number.
_BAND_PLACES = [(4 * sum(hashing.BANDS[:k]), 4 * n) for k, n in enumerate(hashing.BANDS)]


def _words(h: Column, digits: int) -> list[Column]:
    """A hash as numbers of 64 bits."""
    return [F.conv(F.substr(h, F.lit(at), F.lit(16)), 16, -10).cast("long") for at in range(1, digits + 1, 16)]


def _first_shared(x: list[Column]) -> Column:
    """The first band that two hashes share, by the words of their xor."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(_BAND_PLACES))):
        at, n = _BAND_PLACES[k]
        mask = ((1 << n) - 1) << 256 - at - n
        words = [(i, mask >> 64 * (3 - i) & (1 << 64) - 1) for i in range(4)]
        same = [x[i].bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) == 0 for i, m in words if m]
        out = F.when(reduce(Column.__and__, same), k).otherwise(out)
    return out


def near_hash_pairs(left: DataFrame, right: DataFrame, key: str, other: str, hash_col: str, max_bits: int = NEAR_BITS) -> DataFrame:
    """key, other, bits for hashes of 64 digits at most max_bits (12) apart: of 13 bands two such hashes share one.

    Hashes are made numbers before they are banded, and a pair counts under the first band that it shares. Bands are many times the rows, which a plan can't know: the join is a sort merge, never a broadcast.
    For shorter hashes see near_hash_short.
    """

    def banded(df: DataFrame, c: str, side: str) -> DataFrame:
        words = [w.alias(f"_{side}{i}") for i, w in enumerate(_words(F.col("_h"), 64))]
        df = df.select(c, F.col(hash_col).alias("_h")).where(F.col("_h").rlike("^[0-9a-fA-F]{64}$"))
        # spread, as rows are few bytes and their bands much work; bands are made after the explode, else a filter on all of them is pushed under it
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h").select(c, "_h", *words).withColumn("_k", F.explode(F.lit(list(range(len(hashing.BANDS))))))
        digits = F.substr("_h", F.col("_k") * hashing.BANDS[0] + 1, F.lit(hashing.BANDS[0]))  # the last has one less
        return df.select(c, *[f"_{side}{i}" for i in range(4)], (F.conv(digits, 16, 10).cast("long") + F.shiftleft(F.col("_k").cast("long"), 20)).alias("band"))

    x = [F.col(f"_l{i}").bitwiseXOR(F.col(f"_r{i}")) for i in range(4)]
    pairs = banded(left, key, "l").hint("merge").join(banded(right, other, "r").hint("merge"), "band").withColumn("bits", reduce(Column.__add__, [F.bit_count(w) for w in x])).where(F.col("bits") <= max_bits)
    return pairs.where(_first_shared(x) == F.shiftright("band", 20)).select(key, other, "bits").distinct()


def near_hash_short(left: DataFrame, right: DataFrame, key: str, other: str, hash_col: str, max_bits: int = NEAR_BITS) -> DataFrame:
    """As near_hash_pairs, for hashes of 16 hex digits. Hashes that many rows have are compared once."""
    whole = lambda df, c: df.where(F.col(hash_col).rlike("^[0-9a-fA-F]{16}$")).select(c, _words(F.col(hash_col), 16)[0].alias("h"))
    l, r = whole(left, key), whole(right, other)
    near = near_hashes(l, r, max_bits)
    l, r = (df.withColumnRenamed("h", name) for df, name in ((l, "l"), (r, "r")))
    return near.join(l, "l").join(r, "r").select(key, other, "bits").distinct()


def near_hash_any(left: DataFrame, right: DataFrame, key: str, other: str, hash_col: str, max_bits: int = NEAR_BITS) -> DataFrame:
    """As near_hash_pairs, for hashes of any other length than 64 and 16 digits; only hashes of one length meet. The bits are cut into max_bits + 1 bands, whatever their number.

    Hashes of so few bits that a band is empty all meet.
    """
    n = max_bits + 1

    def banded(df: DataFrame, c: str, name: str) -> DataFrame:
        df = df.where(F.col(hash_col).rlike("^[0-9a-fA-F]+$") & ~F.length(hash_col).isin(16, 64)).select(c, F.col(hash_col).alias(name), F.length(hash_col).alias("_digits"))
        words = F.array_join(F.transform(F.split(name, "(?!$)"), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
        df = df.withColumn("_bin", words)
        cut = lambda k: F.floor(F.col("_digits") * 4 * k / n).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), F.substr("_bin", cut(k) + 1, cut(k + 1) - cut(k)).alias("bits")))
        return df.select(c, name, "_digits", F.col("_bin").alias(f"{name}_bin"), F.explode(parts).alias("band"))

    pairs = banded(left, key, "_l").join(banded(right, other, "_r"), ["_digits", "band"]).select(key, other, "_l_bin", "_r_bin").distinct()
    differ = F.aggregate(F.zip_with(F.split("_l_bin", ""), F.split("_r_bin", ""), lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return pairs.withColumn("bits", differ).where(F.col("bits") <= max_bits).select(key, other, "bits")


def judge_image_twins(rows: DataFrame, ledger: DataFrame, max_bits: int = NEAR_BITS) -> DataFrame:
    """Adds twin_date and image_verdict to rows (fingerprint, flyer_phash, start_date, warnings): drop, warn or none.

    The twin is the ledger's smallest fingerprint with a near image. A twin of a known other date makes a warning, any other drops the row.
    """
    known = ledger.where("phash IS NOT NULL").select(F.col("fingerprint").alias("twin"), F.col("phash").alias("flyer_phash"))
    # hashes meet, not rows: an image that many rows have, as a blank one, is compared once
    mine = rows.where("flyer_phash IS NOT NULL").select(F.col("flyer_phash").alias("mine"), "flyer_phash").distinct()
    known = known.groupBy("flyer_phash").agg(F.min("twin").alias("twin"))
    pairs = reduce(DataFrame.unionByName, [near(mine, known, "mine", "twin", "flyer_phash", max_bits) for near in (near_hash_pairs, near_hash_short, near_hash_any)])
    twin = rows.select("fingerprint", F.col("flyer_phash").alias("mine")).join(pairs.groupBy("mine").agg(F.min("twin").alias("twin")), "mine").groupBy("fingerprint").agg(F.min("twin").alias("twin"))
    dates = ledger.select(F.col("fingerprint").alias("twin"), F.col("start_date").alias("twin_date"))
    out = rows.join(twin.join(dates, "twin", "left"), "fingerprint", "left")
    differs = F.coalesce(F.col("twin_date") != F.col("start_date"), F.lit(False))
    verdict = F.when(F.col("twin").isNull(), "none").when(differs, "warn").otherwise("drop")
    note = F.format_string("same flyer image as an item reviewed for %s, but this one says %s - check the date", F.col("twin_date").cast("string"), F.col("start_date").cast("string"))
    out = out.withColumn("image_verdict", verdict)
    return out.withColumn("warnings", F.when(F.col("image_verdict") == "warn", F.array_append("warnings", note)).otherwise(F.col("warnings"))).drop("twin")


def record(ledger: DataFrame, new: DataFrame, stamp: dt.datetime) -> DataFrame:
    """The ledger with new rows (its columns without the times): first_seen stays, blank fields are kept from before, outcome is replaced."""
    new = new.groupBy("fingerprint").agg(*[F.max_by(c, F.struct(F.col(c).isNotNull(), F.col(c))).alias(c) for c in ("title", "start_date", "match_key", "phash", "source", "source_url", "outcome")])
    old = ledger.select("fingerprint", *[F.col(c).alias(f"old_{c}") for c in ledger.columns if c != "fingerprint"])
    both = old.join(new.withColumn("is_new", F.lit(True)), "fingerprint", "full_outer")
    is_new = F.coalesce("is_new", F.lit(False))
    keep = [F.coalesce(F.nullif(c, F.lit("")) if c != "start_date" else F.col(c), f"old_{c}").alias(c) for c in ("title", "start_date", "match_key", "phash", "source", "source_url", "outcome")]
    return both.select(
        "fingerprint", *keep,
        F.coalesce("old_first_seen", F.lit(stamp)).alias("first_seen"),
        F.when(is_new, F.lit(stamp)).otherwise(F.col("old_last_seen")).alias("last_seen"),
    )


def prune(ledger: DataFrame, as_of: dt.date, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Without events that started over keep_days ago; undated ones stay."""
    return ledger.where(~F.coalesce(F.col("start_date") < F.date_sub(F.lit(as_of), keep_days), F.lit(False)))


def forget(ledger: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return ledger.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_anti")


def outcome_histogram(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outcome")


def most_recent(ledger: DataFrame, k: int = 15) -> DataFrame:
    return ledger.orderBy(F.desc("last_seen"), "fingerprint").limit(k)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def save(ledger: DataFrame, folder: str, mark: str = "") -> str:
    """Writes the ledger as a new version in folder, and only then makes it the current one, by a rename. Earlier versions stay, so a plan that reads one still can. Returns the version.

    mark is kept with the version: see recorder.
    """
    spark, version = ledger.sparkSession, f"v-{uuid.uuid4().hex}"
    ledger.write.parquet(f"{folder}/{version}")
    at, fs = _folder(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, current = path(at, f".current-{version}"), path(at, CURRENT)
    out = fs.create(new, True)
    out.write(bytearray(f"{version}\n{mark}", "utf-8"))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(current), overwrite)
    return version


def _current(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The version that counts, and its mark."""
    version, _, mark = spark.read.text(f"{folder}/{CURRENT}", wholetext=True).first()[0].partition("\n")
    return version.strip(), mark.strip()


def recorder(folder: str, stamp: Callable[[int], dt.datetime], name: str = "stream") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: records each batch (the columns of record) in the ledger at folder. stamp gives a batch's time by its number, so that a batch says the same when it comes again.

    The number of the last batch is part of what the rename makes current, so a batch that comes again after a failure changes nothing, and one whose version was written but never became current is recorded
    once. A ledger has one such stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at, fs = _folder(spark, folder)
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, CURRENT)):
            stream, _, last = _current(spark, folder)[1].rpartition(":")
            if stream == name and int(last) >= number:
                return
        save(record(load(spark, folder), batch, stamp(number)), folder, f"{name}:{number}")

    return write


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The current ledger; an empty one where none was saved, or where what was saved can't be read (every file's columns are looked at, and a warning says so)."""
    empty = spark.createDataFrame([], LEDGER)
    at, fs = _folder(spark, folder)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, CURRENT)):
        return empty
    try:
        version = _current(spark, folder)[0]
        found = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{version}")  # reads each file's footer
        return found.select(*[F.col(c).cast(kind) for c, kind in (x.split(" ") for x in LEDGER.split(", "))])
    except (PySparkException, Py4JJavaError, TypeError) as e:
        warnings.warn(f"the ledger at {folder} can't be read, starting empty: {str(e)[:200]}", stacklevel=2)
        return empty


def from_json_text(texts: DataFrame) -> DataFrame:
    """texts: text, each a whole ledger as JSON: {"entries": {fingerprint: fields}}. One that doesn't parse has no entries; fields that aren't known are ignored."""
    kinds = [x.split(" ") for x in LEDGER.split(", ")][1:]
    fields = ",".join(f"{c}:{'string' if kind in ('date', 'timestamp') else kind}" for c, kind in kinds)
    rows = texts.select(F.explode(F.from_json("text", f"entries map<string,struct<{fields}>>").entries).alias("fingerprint", "e"))
    cast = {"date": lambda c: F.try_to_date(F.substr(c, F.lit(1), F.lit(10)), "yyyy-MM-dd"), "timestamp": lambda c: F.try_to_timestamp(c)}
    return rows.select("fingerprint", *[cast.get(kind, lambda c: c)(F.col(f"e.{c}")).alias(c) for c, kind in kinds])
