"""What must not be touched, and whether a file is still as it was seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dictionaries as D
from gleaner.functions import paths
from gleaner.functions.text import holds_any

SETUID, SETGID = 2048, 1024


def without_excluded(entries: DataFrame, prefixes=D.DEFAULT_EXCLUDES) -> DataFrame:
    """``entries`` but those at or below a prefix, component by component."""
    if not prefixes:
        return entries
    return entries.where(~reduce(lambda a, b: a | b, [paths.under(F.col("path"), p) for p in prefixes]))


def classified(entries: DataFrame) -> DataFrame:
    """``entries`` with ``level``, ``reason`` and ``flags_readonly``."""
    path = F.col("path")
    low = F.lower(paths.normalised(path))
    system = paths.lower_extension(path).isin(*D.SYSTEM_EXTENSIONS)
    setuid, setgid = F.col("mode").bitwiseAND(SETUID) != 0, F.col("mode").bitwiseAND(SETGID) != 0
    link = F.col("kind") == "Symlink"
    level = (
        F.when(setuid | setgid | link, "NeverDelete")
        .when(system & holds_any(low, D.WINDOWS_DIRS + D.UNIX_DIRS), "NeverDelete")
        .when(holds_any(low, D.PASSING_DIRS), "WarnBefore")
        .otherwise("Allow")
    )
    reason = (
        F.when(link, "Symlink — cannot safely modify: ")
        .when(setuid, "Setuid binary — system critical: ")
        .when(setgid, "Setgid binary — system critical: ")
        .when(system & holds_any(low, D.WINDOWS_DIRS), "System directory on Windows: ")
        .when(system & holds_any(low, D.UNIX_DIRS), "System directory on Unix: ")
        .when(system, "Executable file — system critical: ")
        .otherwise("Protected file: ")
    )
    return entries.withColumns({"level": level, "reason": F.concat(reason, path), "flags_readonly": F.coalesce("readonly", F.lit(False))})


def changed_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, problem)``: why a file seen before may not be acted on; null where it may.

    The size always counts, the time of change and the physical identity where they were
    seen before.
    """
    a = before.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size_bytes", "mtime_s", "physical_key")])
    b = now.select("path", "size_bytes", "mtime_s", "physical_key", F.lit(True).alias("there"))
    problem = (
        F.when(F.col("there").isNull(), "cannot stat file")
        .when(F.col("size_bytes") != F.col("old_size_bytes"), F.concat_ws("", F.lit("size "), "old_size_bytes", F.lit("→"), "size_bytes"))
        .when(F.col("old_mtime_s").isNotNull() & F.col("mtime_s").isNull(), "mtime no longer readable")
        .when(F.col("old_mtime_s") != F.col("mtime_s"), F.concat_ws("", F.lit("mtime "), "old_mtime_s", F.lit("→"), "mtime_s"))
        .when(F.col("old_physical_key").isNotNull() & ~F.col("physical_key").eqNullSafe(F.col("old_physical_key")), "physical identity mismatch")
    )
    return a.join(b, "path", "left").select("path", problem.alias("problem"))
