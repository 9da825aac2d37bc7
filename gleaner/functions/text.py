"""Sizes, durations, dates and notes as people read them, and words of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F


def _sized(n, base: int, units, digits: int, small):
    """Decimals of the quotient as a double holds it, ties to the even one: 1015 bytes are 1.01 KB. Sizes of any whole type, up to 2^63 of the largest unit."""
    out, one = small, 10**digits
    for power, unit in enumerate(units, 1):
        size = n / float(base**power)
        parts = F.rint((size - F.floor(size)) * float(one)).cast("long")
        whole = F.floor(size) + F.when(parts == one, 1).otherwise(0)
        out = F.when(n >= base**power, F.format_string(f"%d.%0{digits}d {unit}", whole, parts % one)).otherwise(out)
    return out


def decimal_size(n, digits: int = 2):
    """``1.50 KB``, ``2.00 MB`` ...: powers of 1000, up to GB."""
    return _sized(n, 1000, ("KB", "MB", "GB"), digits, F.concat(n.cast("string"), F.lit(" B")))


def binary_size(n):
    """``1.5 KB`` and so on in powers of 1024, up to TB."""
    return _sized(n, 1024, ("KB", "MB", "GB", "TB"), 1, F.concat(n.cast("string"), F.lit(" B")))


def duration(seconds):
    """``45s``, ``2m 5s``, ``1h 1m``."""
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def holds_any(text, words):
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_score(text, scores):
    """The score of the first pattern that the text holds, else 0."""
    return reduce(lambda out, x: F.when(F.contains(text, F.lit(x[0])), x[1]).otherwise(out), reversed(scores), F.lit(0))


def keeper_note(path):
    low = F.lower(path)
    return (
        F.when(holds_any(low, ("copy", "copia")), "copy name")
        .when(holds_any(low, ("(1)", "(2)")), "numbered copy")
        .when(F.contains(low, F.lit("backup")), "backup")
        .when(F.contains(low, F.lit("old")), "old version")
        .otherwise("")
    )


def clock(seconds):
    """``YYYY-MM-DD HH:MM:SS`` in UTC of Unix seconds; years of five digits have no sign."""
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("+"))


def iso_seconds(text):
    """Unix seconds of an ISO 8601 time in UTC; null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def exif_seconds(text):
    """Unix seconds of ``YYYY:MM:DD HH:MM:SS`` in UTC; null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def degrees(value):
    """Degrees, minutes and hundredths of seconds of an angle, as rational parts."""
    a = F.abs(value)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.round(((a - d) * 60 - m) * 60 * 100)
    return F.struct(d.cast("long").alias("degrees"), m.cast("long").alias("minutes"), s.cast("long").alias("hundredths"))


def folder_name(path):
    """The last part of a path, as reports are named after it; that of the root, or of none, is ``root``."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(F.coalesce(path, F.lit("")).isin("", "/"), "root").when(name.isin("", "..", "."), "unknown").otherwise(name)


def with_sidecars(pictures, sidecars):
    """``pictures(path, ...)`` that have a side-car at ``path`` and ``.json``: ``mtime_s``, and the place as EXIF has it.

    ``sidecars`` has ``sidecar`` (its path), ``taken``, ``latitude`` and ``longitude``.
    """
    joined = pictures.join(sidecars, F.concat(pictures["path"], F.lit(".json")) == sidecars["sidecar"])
    places = []
    for name, plus, minus in (("latitude", "N", "S"), ("longitude", "E", "W")):
        parts = degrees(F.col(name))
        places.append(F.when(F.col(name) >= 0, plus).otherwise(minus).alias(f"{name}_ref"))
        places += [parts[p].alias(f"{name}_{p}") for p in ("degrees", "minutes", "hundredths")]
    return joined.select(*[pictures[c] for c in pictures.columns], F.col("taken").alias("mtime_s"), *places)
