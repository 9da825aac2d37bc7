"""Junk: seven detectors over an inventory, tiered by risk, and what they add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dictionaries as D
from gleaner.functions import paths
from gleaner.operators.tables import written

COLUMNS = ("path", "category", "risk", "size_bytes", "explanation", "can_clean")


def _items(found: DataFrame, category: str, risk, explanation, can_clean) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
    return found.select(
        "path", F.lit(category).alias("category"), lit(risk).alias("risk"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"),
        lit(explanation).alias("explanation"), lit(can_clean).alias("can_clean"),
    )


def with_blacklist(entries: DataFrame) -> DataFrame:
    """``entries`` with ``blacklisted``: version control, intended markers and live projects."""
    path = F.col("path")
    live = entries.where(paths.file_name(path).isin(*D.LOCK_FILES)).select(paths.parent(path).alias("__live")).distinct()
    joined = entries.join(live, paths.parent(path) == F.col("__live"), "left")
    listed = path.rlike(r"/\.(git|hg|svn|bzr)(/|$)") | (paths.file_name(path) == ".nomedia")
    return joined.withColumn("blacklisted", listed | (F.contains(path, F.lit("node_modules")) & F.col("__live").isNotNull())).drop("__live")


def allowed(entries: DataFrame) -> DataFrame:
    """Entries that are not blacklisted; ``entries`` may have the column already."""
    listed = entries if "blacklisted" in entries.columns else with_blacklist(entries)
    return listed.where(~F.col("blacklisted"))


def empty_files(entries: DataFrame) -> DataFrame:
    found = allowed(entries).where((F.col("kind") == "File") & (F.col("size_bytes") == 0))
    return _items(found, "Empty Files", "Low", "Empty file (0 bytes)", True)


def is_system_name(path):
    name = paths.file_name(path)
    return reduce(lambda a, b: a | b, [F.startswith(name, F.lit(p)) for p in D.SYSTEM_NAMES])


def empty_directories(entries: DataFrame) -> DataFrame:
    """Directories without a file below them but system ones: nothing is walked level by level.

    Every file that counts marks all directories above it; those never marked are empty.
    """
    path = F.col("path")
    parts = F.split("path", "/")
    real = entries.where((F.col("kind") == "File") & ~is_system_name(path)).select(paths.parent(path).alias("path")).distinct()
    above = real.select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    parents = entries.select(paths.parent(path).alias("path")).distinct().withColumn("has_children", F.lit(True))
    folders = entries.where(F.col("kind") == "Directory").dropDuplicates(["path"])
    found = folders.join(above, "path", "left_anti").join(parents, "path", "left")
    text = F.when(F.col("has_children"), "Directory contains only empty subdirectories").otherwise("Empty directory")
    return _items(found, "Empty Directories", "Low", text, True)


def temporary_files(entries: DataFrame, now: int) -> DataFrame:
    """Temporary names; a month old they may go. ``now`` is in Unix seconds."""
    path = F.col("path")
    name, ext = paths.file_name(path), paths.lower_extension(path)
    has_ext = paths.extension(path).isNotNull()
    lock, backup, dump = F.startswith(name, F.lit("~$")), F.endswith(name, F.lit("~")), F.startswith(name, F.lit("core."))
    found = allowed(entries).where((F.col("kind") == "File") & ((has_ext & ext.isin(*D.TEMPORARY_EXTENSIONS)) | lock | backup | dump))
    days = F.coalesce(((F.lit(now) - F.col("mtime_s")) / 86400).cast("long"), F.lit(0))
    old = days > 30
    text = (
        F.when(lock, F.concat(F.lit("Office lock file: "), name))
        .when(backup, F.concat(F.lit("Editor backup file: "), name))
        .when(dump, F.concat(F.lit("Crash dump: "), name))
        .when(ext.isin(*D.SWAP_EXTENSIONS), F.concat(F.lit("Vim swap file: "), name))
        .otherwise(F.concat(F.lit("Temporary file (."), ext, F.lit("): "), name))
    )
    return _items(found, "Temporary Files", F.when(old, "Low").otherwise("Medium"), text, old)


def broken_symlinks(entries: DataFrame, working: str | None = None) -> DataFrame:
    """Links to nothing in the inventory; relative ones are taken from the link's own folder, or from ``working`` if given."""
    folder = F.lit(working) if working else paths.parent(F.col("path"))
    target = F.when(F.startswith("link_target", F.lit("/")), F.col("link_target")).otherwise(F.concat_ws("/", folder, "link_target"))
    links = allowed(entries).where((F.col("kind") == "Symlink") & F.col("link_target").isNotNull()).withColumn("__target", target)
    there = entries.select(F.col("path").alias("__target")).distinct()
    found = links.join(there, "__target", "left_anti")
    return _items(found, "Broken Symlinks", "Medium", F.concat(F.lit("Broken symlink → "), "link_target"), False)


def cache_directories(entries: DataFrame) -> DataFrame:
    """Caches of tools; an environment beside its project file is in use."""
    path = F.col("path")
    name = paths.file_name(path)
    found = allowed(entries).where((F.col("kind") == "Directory") & name.isin(*D.CACHE_DIRS))
    project = entries.where(name == "pyproject.toml").select(paths.parent(path).alias("__project")).distinct()
    found = found.join(project, (paths.parent(path) == F.col("__project")) & (name == ".venv"), "left_anti")
    return _items(found, "Cache Files", "High", F.concat(F.lit("Development cache directory: "), name), False)


def system_junk(entries: DataFrame) -> DataFrame:
    path = F.col("path")
    held = reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in D.SYSTEM_PATHS])
    found = entries.where((F.col("kind") == "File") & (is_system_name(path) | held))
    return _items(found, "System Junk", "Low", F.concat(F.lit("System metadata file: "), paths.file_name(path)), True)


def orphan_sidecars(entries: DataFrame) -> DataFrame:
    """Sidecars whose companions aren't in the inventory: their possible names, exploded, against all paths."""
    path = F.col("path")
    takeout = r"\.(?:" + "|".join(f"{x}|{x.upper()}" for x in D.TAKEOUT_EXTENSIONS) + r")\.json$"
    rules = F.when(F.lit(False), F.array(F.lit("")))
    text = F.when(F.lit(False), F.lit(""))
    for suffix, why, wanted in D.SIDECARS:
        ends = F.endswith(path, F.lit(suffix))
        rules = rules.when(ends, F.transform(F.array(*[F.lit(x) for x in wanted]), lambda x: F.concat(F.col("__base"), F.lit("."), x)))
        text = text.when(ends, F.lit(why))
    more = F.endswith(path, F.lit(".supplemental-metadata.json"))
    rules = rules.when(more, F.array(F.regexp_replace(path, r"\.supplemental-metadata\.json$", ""))).when(path.rlike(takeout), F.array(F.regexp_replace(path, r"\.json$", "")))
    text = text.when(more | path.rlike(takeout), "companion media file was deleted (Google Takeout metadata)")
    based = entries.withColumn("__base", F.concat_ws("/", paths.parent(path), paths.file_stem(path)))
    sidecars = based.withColumns({"__wanted": rules, "__why": text}).where(F.col("__wanted").isNotNull())
    there = entries.select(F.col("path").alias("__candidate")).distinct()
    matched = sidecars.select("path", F.explode("__wanted").alias("__candidate")).join(there, "__candidate", "left_semi").select("path").distinct()
    found = sidecars.join(matched, "path", "left_anti")
    return _items(found, "Orphan Sidecars", "Medium", F.concat(F.lit("Orphan sidecar: "), paths.file_stem(path), F.lit(" "), F.col("__why")), True)


DETECTORS = ("empty_files", "empty_directories", "temporary_files", "broken_symlinks", "cache_directories", "system_junk", "orphan_sidecars")


def report(entries: DataFrame, now: int) -> DataFrame:
    """All items of all detectors but blacklisted paths; a file may be there once for each detector.

    The inventory, without contents, is written once with its blacklist; the detectors read that.
    """
    entries = written(with_blacklist(entries.drop("content")), "listed")
    found = [temporary_files(entries, now) if d == "temporary_files" else globals()[d](entries) for d in DETECTORS]
    items = reduce(DataFrame.unionByName, found)
    kept = allowed(entries).select("path").distinct()
    return items.join(kept, "path", "left_semi").select(*COLUMNS)


def by_category(items: DataFrame) -> DataFrame:
    """Counts and bytes by category, and the total in a row of its own."""
    out = items.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "n", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def by_risk(items: DataFrame) -> DataFrame:
    """Counts of the three risks and their shares in per cent, 0 where there are no items."""
    n = F.count(F.lit(1))
    counts = {r.lower(): F.count_if(F.col("risk") == r) for r in ("Low", "Medium", "High")}
    share = {f"{k}_pct": F.when(n > 0, F.round(100.0 * c / n, 4)).otherwise(0.0).alias(f"{k}_pct") for k, c in counts.items()}
    return items.agg(n.alias("total_items"), *[c.alias(k) for k, c in counts.items()], *share.values())


def cleanup(items: DataFrame) -> DataFrame:
    """What may be deleted at once, and what is put aside first."""
    action = F.when((F.col("risk") == "Low") & F.col("can_clean"), "delete").when(F.col("risk") == "Medium", "quarantine")
    return items.withColumn("action", action).where(F.col("action").isNotNull()).select("path", "category", "size_bytes", "action")


def manifest(plan: DataFrame) -> DataFrame:
    """``(path, size_bytes, action)`` of what a clean-up takes away."""
    return plan.where(F.col("action").isin("delete", "quarantine")).select("path", "size_bytes", "action")
