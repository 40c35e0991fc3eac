"""Keys of a record, and the distance of image hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_key, normalize_location

#: Hex digits of the bands of a 64-digit hash: 13 bands, so that hashes up to 12 bits apart share one.
BANDS = (5,) * 12 + (4,)


def iso(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))


def fingerprint(url: Column, title: Column, start: Column, location: Column) -> Column:
    parts = F.concat_ws("|", F.coalesce(url, F.lit("")), normalize_key(title), iso(start), normalize_location(location))
    return F.substr(F.sha1(parts.cast("binary")), F.lit(1), F.lit(16))


def match_key(start: Column, location: Column) -> Column:
    return F.concat(iso(start), F.lit("|"), normalize_location(location))


def hamming(a: Column, b: Column, digits: int = 64) -> Column:
    """Bits that differ; null unless both have as many hex digits. By words of 8 digits, as longer ones overflow."""
    total = F.lit(0)
    for at in range(1, digits + 1, 8):
        word = lambda x: F.conv(F.substr(x, F.lit(at), F.lit(8)), 16, 10).cast("long")  # noqa: B023, E731
        total = total + F.bit_count(word(a).bitwiseXOR(word(b)))
    ok = lambda x: x.rlike(rf"^[0-9a-fA-F]{{{digits}}}$")
    return F.when(ok(a) & ok(b), total)


def bands(h: Column, sizes=BANDS) -> Column:
    """array<string>: place and digits of each band."""
    out, at = [], 1
    for k, n in enumerate(sizes):
        out.append(F.concat(F.lit(f"{k}:"), F.substr(F.lower(h), F.lit(at), F.lit(n))))
        at += n
    return F.array(*out)
