"""Tables that outlive a run: cached digests and fingerprints, the quarantine journal, kept files.

All are append-only; the latest row of a key counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def latest(rows: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """The row of the largest ``order`` for each key; combined before the shuffle, so a key may have any number of rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in rest])).alias("m")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def witnessed(mtime, old_mtime, ctime, old_ctime):
    """Whether a cached value still holds: both times of change known and equal, and those of status if known."""
    return F.coalesce((mtime == old_mtime) & ((ctime == old_ctime) | ctime.isNull() | old_ctime.isNull()), F.lit(False))


def probe(files: DataFrame, cache: DataFrame, value: str, keys=("physical_key", "size_bytes")) -> DataFrame:
    """``files`` with ``value`` from the cache, null on a miss.

    Identities that stand in for unknown ones (``path:``) never match.
    """
    known = latest(cache, list(keys)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("mtime_ns").alias("__m"), F.col("ctime_ns").alias("__c"), F.col(value).alias("__v"))
    on = [files[k] == known[f"__{k}"] for k in keys] + [~F.startswith(files["physical_key"], F.lit("path:"))]
    joined = files.join(known, on, "left")
    hit = witnessed(F.col("mtime_ns"), F.col("__m"), F.col("ctime_ns"), F.col("__c"))
    return joined.select(*[F.col(c) for c in files.columns], F.when(hit, F.col("__v")).alias(value))


def invalidated(cache: DataFrame, stale: DataFrame) -> DataFrame:
    """The cache without any row of the stale identities."""
    return cache.join(stale.select("physical_key").distinct(), "physical_key", "left_anti")


def pruned(cache: DataFrame, now: int, days: int = 30, most: int = 100_000, target: int = 90_000) -> DataFrame:
    """Rows of at most ``days`` days; if there are more than ``most``, the ``target`` newest of them.

    The line is drawn on counts by time, of which there are as many as distinct times kept.
    """
    fresh = cache.where(F.col("created_at") >= now - days * DAY)
    if fresh.count() <= most:
        return fresh
    return fresh.orderBy(F.desc("created_at"), "physical_key").limit(target)


def expired(journal: DataFrame, now: str) -> DataFrame:
    """Entries whose purge time, as text, is before ``now``."""
    return journal.where(F.col("purge_at") < F.lit(now))


def by_reason(journal: DataFrame, pattern: str) -> DataFrame:
    return journal.where(F.col("reason").like(pattern))


def sessions(journal: DataFrame) -> DataFrame:
    """One row for each session; its first entry gives mode, label and source."""
    first = F.min(F.struct("id", "reason", "path", "moved_at")).alias("f")
    found = journal.groupBy("session_id").agg(first, F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    reason = F.col("f.reason")
    mode = F.when(F.contains(reason, F.lit("junk")), "junk").when(F.contains(reason, F.lit("similar")), "similar").otherwise("exact")
    title = F.when(mode == "junk", "Junk").otherwise(mode)
    return found.select(
        "session_id", mode.alias("mode"), F.concat(title, F.lit(" cleanup · "), F.col("f.path")).alias("label"),
        F.regexp_replace("f.path", "/[^/]+/*$", "").alias("source_path"), F.col("f.moved_at").alias("cleaned_at"), "files", "bytes",
    )


def healed(journal: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose file is still in the quarantine folder."""
    return journal.join(listing.select("path").distinct(), "path", "left_semi")


def strays(journal: DataFrame, listing: DataFrame) -> DataFrame:
    """Files in the quarantine folder that the journal doesn't know."""
    return listing.join(journal.select("path").distinct(), "path", "left_anti")


def kept_files(before: DataFrame, new: DataFrame) -> DataFrame:
    """Files kept by any pass, with the time of the last one."""
    return before.unionByName(new).groupBy("path").agg(F.max("kept_at").alias("kept_at"))


def region_key(kind, first=None, second=None):
    """The part of a cache key that tells what was hashed; numbers that a kind does not have are -1, and samples are one key."""
    whole = lambda x: F.coalesce(x, F.lit(-1)) if x is not None else F.lit(-1)
    sampled = kind == "sampled"
    return F.concat_ws(":", kind, F.when(sampled, -1).otherwise(whole(first)).cast("string"), F.when(sampled, -1).otherwise(whole(second)).cast("string"))


#: What a cached fingerprint is found by, besides the witnesses: another detector, setting or version is another row.
FINGERPRINT_KEYS = ("physical_key", "size_bytes", "detector", "params", "algo_version")


def probe_fingerprints(files: DataFrame, cache: DataFrame, detector: str, params: str, version: int) -> DataFrame:
    """``files`` with ``data`` and ``error`` that were cached for this detector, and ``cached``.

    A failure that was cached is reported again without another try.
    """
    held = cache.select(*cache.columns, F.struct("data", "error").alias("found"))
    asked = files.withColumns({"detector": F.lit(detector), "params": F.lit(params), "algo_version": F.lit(version)})
    out = probe(asked, held, "found", FINGERPRINT_KEYS)
    return out.select(*files.columns, F.col("found.data").alias("data"), F.col("found.error").alias("error"), F.col("found").isNotNull().alias("cached"))


def hashed(files: DataFrame, cache: DataFrame, digest) -> DataFrame:
    """``files`` with ``digest``, cached or else made by the column ``digest``, and ``was_cached``.

    What the cache knows is not read: ``digest`` is asked for a path that is null there.
    """
    known = probe(files, cache, "digest").withColumn("was_cached", F.col("digest").isNotNull())
    made = digest(F.when(~F.col("was_cached"), F.col("path")))
    return known.withColumn("digest", F.coalesce("digest", made))


def with_provenance(members: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` with ``any_cached``: whether a digest of the group, which ``keys`` name, was cached."""
    any_cached = members.groupBy(*keys).agg(F.bool_or("was_cached").alias("any_cached"))
    return members.join(any_cached, keys)


def fresh_rows(members: DataFrame, now: int) -> DataFrame:
    """Rows to append to the cache: what ``hashed`` had to make; stand-in identities are not cached."""
    known = F.startswith("physical_key", F.lit("path:"))
    return members.where(~F.col("was_cached") & F.col("digest").isNotNull() & ~known).select(
        "physical_key", "size_bytes", "mtime_ns", "ctime_ns", "digest", F.lit(now).cast("long").alias("created_at")
    )


def stale_groups(compared: DataFrame) -> DataFrame:
    """``(physical_key)`` of all members of cached groups in which a comparison found a difference: their digests can't be trusted."""
    bad = compared.groupBy("group_id").agg(F.bool_or((F.col("verdict") == "different") & F.col("any_cached")).alias("bad")).where("bad")
    return compared.join(bad.select("group_id"), "group_id", "left_semi").select("physical_key").distinct()


def active(events: DataFrame) -> DataFrame:
    """Entries of an append-only journal ``(id, event, at, ...)`` whose last event is that they were moved."""
    return latest(events, ["id"], "at").where(F.col("event") == "moved")
