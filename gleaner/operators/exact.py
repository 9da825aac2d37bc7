"""Exact duplicates: size, then a partial digest, then a full one, then the bytes.

Each step drops what stands alone before the next one reads more. Content is joined only to
paths that are still candidates, and groups are rows of members, never arrays. Entries
without a ``content`` column are files that lie at their paths: they are read there, a
block at a time, and may have any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import hashing, paths
from gleaner.operators.tables import written
from gleaner.sources import folders


def regular_files(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("kind") == "File")


def empty_files(entries: DataFrame) -> DataFrame:
    """Files of no bytes; an unknown size counts as none."""
    return regular_files(entries).where(F.coalesce("size_bytes", F.lit(0)) == 0)


def discovery_summary(entries: DataFrame) -> DataFrame:
    """Counts by kind and the bytes of all files, in one row."""
    kind = F.col("kind")
    return entries.agg(
        F.count_if(kind == "File").alias("files"),
        F.count_if(kind == "Directory").alias("directories"),
        F.count_if(kind == "Symlink").alias("symlinks"),
        F.count_if(~kind.isin("File", "Directory", "Symlink")).alias("others"),
        F.coalesce(F.sum(F.when(kind == "File", F.coalesce("size_bytes", F.lit(0)))), F.lit(0)).alias("total_file_bytes"),
    )


def physical_files(entries: DataFrame) -> DataFrame:
    """One row for each physical identity of the non-empty files; the first path stands for it."""
    found = regular_files(entries).where(F.col("size_bytes") > 0)
    first = F.struct(paths.components(F.col("path")).alias("c"), F.col("root_id").alias("r"), F.col("path").alias("p"), F.col("size_bytes").alias("s"))
    return (
        found.groupBy("physical_key")
        .agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("links"))
        .select("physical_key", F.col("f.p").alias("path"), F.col("f.s").alias("size_bytes"), "links")
    )


def hardlink_clusters(entries: DataFrame) -> DataFrame:
    return physical_files(entries).where(F.col("links") > 1)


def physical_summary(entries: DataFrame) -> DataFrame:
    """Physical files, clusters, paths that add nothing, and empty files."""
    found = physical_files(entries).agg(
        F.count(F.lit(1)).alias("physical_files"),
        F.count_if(F.col("links") > 1).alias("hardlink_clusters"),
        F.coalesce(F.sum(F.col("links") - 1), F.lit(0)).alias("duplicate_paths_removed"),
    )
    empty = empty_files(entries).agg(F.count(F.lit(1)).alias("empty_files"))
    return found.join(F.broadcast(empty)).withColumn("overlapping", F.col("duplicate_paths_removed") > 0)


def size_groups(physical: DataFrame) -> DataFrame:
    """Sizes that at least two physical files share."""
    return physical.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)


def _grouped(members: DataFrame, keys: list[str]) -> DataFrame:
    """The members whose keys at least two of them share; counts are combined before their shuffle.

    Members are a few short columns; written once, they are counted and filtered without
    doing the steps before them twice.
    """
    members = written(members.drop("n_files"), "members")
    shared = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)
    return members.join(shared, keys)


def _hashed(entries: DataFrame, members: DataFrame, name: str, of_content, of_path) -> DataFrame:
    """``members`` with a digest ``name``, of their content in ``entries`` or else of the files at their paths."""
    if "content" not in entries.columns:
        return members.withColumn(name, of_path(F.col("path")))
    content = regular_files(entries).select("path", F.col("content").cast("binary").alias("content"))
    return members.join(content, "path").withColumn(name, of_content(F.col("content"))).drop("content")


def candidates(entries: DataFrame) -> DataFrame:
    return _grouped(physical_files(entries), ["size_bytes"])


def partial_members(entries: DataFrame, head_only: bool = False, chunk: int = hashing.CHUNK, found: DataFrame | None = None) -> DataFrame:
    """Candidates (``found``, if they are known) whose size and partial digest others share, with ``partial``."""
    found = candidates(entries) if found is None else found
    hashed = _hashed(entries, found, "partial", lambda c: hashing.partial_digest(c, head_only, chunk), lambda p: folders.partial_digest(p, head_only, chunk))
    return _grouped(hashed, ["size_bytes", "partial"])


def full_members(entries: DataFrame, head_only: bool = False, chunk: int = hashing.CHUNK, found: DataFrame | None = None) -> DataFrame:
    """Members of groups with one size, partial and full digest. Files that the partial region covers aren't read again."""
    covered = hashing.region_covers(F.col("size_bytes"), chunk if head_only else 2 * chunk)
    members = partial_members(entries, head_only, chunk) if found is None else found
    # A Python function takes every row it is given, whatever the condition around it: covered files get no path.
    full = lambda digest: F.when(covered, F.col("partial")).otherwise(digest)
    hashed = _hashed(entries, members, "full", lambda c: full(hashing.digest(c)), lambda p: full(folders.full_digest(F.when(~covered, p))))
    grouped = _grouped(hashed, ["size_bytes", "partial", "full"])
    return grouped.withColumn("group_id", F.sha2(F.concat(F.col("size_bytes").cast("string"), F.lit(":"), "full").cast("binary"), 256))


def byte_compare(entries: DataFrame, members: DataFrame, mode: str = "always", cached: DataFrame | None = None) -> DataFrame:
    """``members`` with ``verdict``: ``confirmed``, ``different`` or ``trusted``.

    ``never`` trusts every group, ``cached_only`` those without a path in ``cached(path)``;
    the others are compared, byte by byte, with the first member of their group.
    """
    if mode == "never":
        return members.withColumn("verdict", F.lit("trusted"))
    first = members.groupBy("group_id").agg(F.min(F.struct(paths.components(F.col("path")).alias("c"), F.col("path").alias("p"))).alias("f"))
    heads = first.select("group_id", F.col("f.p").alias("path"))
    if "content" in entries.columns:
        content = regular_files(entries).select("path", "content")
        heads = heads.join(content, "path").select("group_id", F.col("content").alias("head"))
        out, same = members.join(content, "path").join(heads, "group_id"), F.col("content") == F.col("head")
    else:
        out, same = members.join(heads.withColumnRenamed("path", "head"), "group_id"), folders.same_bytes(F.col("path"), F.col("head"))
    out = out.withColumn("verdict", F.when(same, "confirmed").when(~same, "different")).drop("content", "head")
    if mode == "cached_only":
        touched = members.join(cached.select("path").distinct(), "path", "left_semi").select("group_id").distinct().withColumn("touched", F.lit(True))
        out = out.join(touched, "group_id", "left")
        out = out.withColumn("verdict", F.when(F.col("touched"), F.col("verdict")).otherwise("trusted")).drop("touched")
    return out


def confirmed_members(entries: DataFrame, mode: str = "always", cached: DataFrame | None = None) -> DataFrame:
    """Members that stayed in groups of two or more; ``cached(path)`` is what ``cached_only`` compares.

    Files that can't be read any more, and so can't be compared, have a null verdict and
    leave their groups.
    """
    kept = byte_compare(entries, full_members(entries), mode, cached).where(F.col("verdict") != "different")
    return _grouped(kept.drop("n_files"), ["group_id"])


def exact_summary(entries: DataFrame) -> DataFrame:
    """What each step kept, in one row."""

    def counts(members, key, groups, files):
        per = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("size_bytes").alias("s"))
        return per.agg(F.count(F.lit(1)).alias(groups), F.coalesce(F.sum("n"), F.lit(0)).alias(files), F.coalesce(F.sum(F.col("s") * (F.col("n") - 1)), F.lit(0)).alias("reclaimable"))

    first = candidates(entries)
    second = partial_members(entries, found=first)
    third = full_members(entries, found=second)
    sizes = counts(first, ["size_bytes"], "size_groups", "candidates").drop("reclaimable")
    partial = counts(second, ["size_bytes", "partial"], "partial_groups", "promoted_to_full").drop("reclaimable")
    full = counts(third, ["group_id"], "confirmed_groups", "confirmed_files")
    # Three tables of one row each.
    return (
        sizes.join(F.broadcast(partial)).join(F.broadcast(full))
        .withColumn("eliminated_by_partial", F.col("candidates") - F.col("promoted_to_full"))
        .withColumn("eliminated_by_full", F.col("promoted_to_full") - F.col("confirmed_files"))
    )
