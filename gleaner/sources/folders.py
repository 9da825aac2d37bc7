"""A data source that walks folders, and digests of the files found.

``spark.dataSource.register(FolderSource)`` and
``spark.read.format("gleaner_files").option("roots", "/a,/b").load()``. What can't be read is
a row with ``error``, and never ends the walk. Every executor must see the folders.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = """root_id int, path string, kind string, depth int, size_bytes long, readonly boolean, mtime_s long, mtime_ns long, ctime_ns long,
physical_key string, mode int, link_target string, error string, message string"""


def _flag(options, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


def _error(e: OSError) -> str:
    return "NotFound" if isinstance(e, FileNotFoundError) else "PermissionDenied" if isinstance(e, PermissionError) else "Io"


class Part(InputPartition):
    """One folder to walk: with everything below it, or (``deep`` false) the entries it holds itself."""

    def __init__(self, root_id: int, root: str, start: str, deep: bool):
        self.root_id, self.root, self.start, self.deep = root_id, root, start, deep


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [os.path.abspath(r.strip()) for r in options.get("roots", "").split(",") if r.strip()]
        if not self.roots:
            raise ValueError("option roots names no folder")
        self.follow = _flag(options, "follow_symlinks", False)
        self.links = _flag(options, "include_symlink_entries", True)
        self.hidden = _flag(options, "include_hidden", False)
        self.ignore = _flag(options, "respect_gitignore", False)
        self.excluded = [p.strip() for p in options.get("exclude_prefixes", "").split(",") if p.strip()]

    def partitions(self):
        out = []
        for i, root in enumerate(self.roots):
            out.append(Part(i, root, root, False))
            try:
                with os.scandir(root) as found:
                    out += [Part(i, root, e.path, True) for e in sorted(found, key=lambda e: e.name) if e.is_dir(follow_symlinks=self.follow) and not self._skip(root, e, self._rules(root))]
            except OSError:
                pass  # the first part reports it
        return out

    def _rules(self, folder: str) -> list[str]:
        if not self.ignore:
            return []
        try:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8") as f:
                return [line.strip() for line in f if line.strip() and not line.startswith("#")]
        except OSError:
            return []

    def _skip(self, root: str, entry, rules) -> bool:
        if not self.hidden and entry.name.startswith("."):
            return True
        for p in self.excluded:
            prefix = p if os.path.isabs(p) else os.path.join(root, p)
            if entry.path == prefix or entry.path.startswith(prefix + "/"):
                return True
        for rule in rules:
            name = rule.strip("/")
            if fnmatch.fnmatch(entry.name, name) and (not rule.endswith("/") or entry.is_dir(follow_symlinks=False)):
                return True
        return False

    def read(self, part: Part) -> Iterator[tuple]:
        base = part.root.rstrip("/").count("/")
        todo = [(part.start, [])]
        if not part.deep:
            yield from self._row(part, part.root, base)
        while todo:
            folder, inherited = todo.pop()
            try:
                with os.scandir(folder) as found:
                    listed = sorted(found, key=lambda e: e.name)
            except OSError as e:
                if part.deep or folder != part.root or os.path.exists(folder):
                    yield self._failed(part, folder, e)
                continue
            rules = inherited + self._rules(folder)
            for e in listed:
                try:
                    e.path.encode("utf-8")
                except UnicodeEncodeError:
                    yield (part.root_id, repr(e.path), *[None] * 10, "InvalidPath", "path is not UTF-8")
                    continue
                if self._skip(part.root, e, rules):
                    continue
                inner = e.is_dir(follow_symlinks=self.follow)
                yield from self._row(part, e.path, base)
                if inner and part.deep:
                    todo.append((e.path, rules))

    def _failed(self, part, path, e):
        return (part.root_id, path, *[None] * 10, _error(e), str(e))

    def _row(self, part, path, base):
        try:
            seen = os.stat(path) if self.follow else os.lstat(path)
        except OSError as e:
            yield self._failed(part, path, e)
            return
        kind = "File" if stat.S_ISREG(seen.st_mode) else "Directory" if stat.S_ISDIR(seen.st_mode) else "Symlink" if stat.S_ISLNK(seen.st_mode) else "Other"
        if kind == "Symlink" and not self.links:
            return
        key = f"unix:{seen.st_dev:016x}{seen.st_ino:016x}" if seen.st_dev or seen.st_ino else f"path:{path}"
        times = seen.st_mtime_ns >= 0
        yield (
            part.root_id, path, kind, path.rstrip("/").count("/") - base, seen.st_size if kind == "File" else None, not seen.st_mode & stat.S_IWUSR,
            seen.st_mtime_ns // 1_000_000_000 if times else None, seen.st_mtime_ns if times else None, seen.st_ctime_ns, key, seen.st_mode,
            os.readlink(path) if kind == "Symlink" else None, None, None,
        )


class FolderSource(DataSource):
    @classmethod
    def name(cls):
        return "gleaner_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FolderReader(self.options)


def discover(spark: SparkSession, roots, **options) -> tuple[DataFrame, DataFrame]:
    """``(entries, errors)`` of some folders; options as the data source has them."""
    spark.dataSource.register(FolderSource)
    found = spark.read.format("gleaner_files").option("roots", ",".join(roots)).options(**options).load()
    return found.where("error IS NULL").drop("error", "message"), found.where("error IS NOT NULL").select("root_id", "path", "error", "message")


def file_digests(entries: DataFrame, chunk: int = 4096) -> DataFrame:
    """``entries`` with ``partial`` and ``full`` digests, read where the files are, 64 KB at a time.

    A file that can't be read has null digests and an ``error``. The partial digest is of
    the non-overlapping head and tail; where these cover a file it is also the full one.
    """

    @F.pandas_udf("partial string, full string, error string")
    def digest(paths: pd.Series) -> pd.DataFrame:
        out = []
        for path in paths:
            try:
                size = os.path.getsize(path)
                with open(path, "rb") as f:
                    full, partial = hashlib.sha256(), hashlib.sha256()
                    while block := f.read(1 << 16):
                        full.update(block)
                    if size <= 2 * chunk:
                        partial = full
                    else:
                        f.seek(0)
                        partial.update(f.read(chunk))
                        f.seek(size - chunk)
                        partial.update(f.read(chunk))
                out.append((partial.hexdigest(), full.hexdigest(), None))
            except OSError as e:
                out.append((None, None, _error(e)))
        return pd.DataFrame(out, columns=["partial", "full", "error"])

    return entries.withColumn("__d", digest("path")).select("*", "__d.*").drop("__d")


BLOCK = 1 << 20


def _pieces(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(BLOCK):
            yield piece


def _full(path: str) -> str:
    found = hashlib.sha256()
    for piece in _pieces(path):
        found.update(piece)
    return found.hexdigest()


def _partial(path: str, head_only: bool, chunk: int) -> str:
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        if head_only or size > 2 * chunk:
            found = hashlib.sha256(f.read(chunk))
            if not head_only:
                f.seek(size - chunk)
                found.update(f.read(chunk))
            return found.hexdigest()
        return hashlib.sha256(f.read(2 * chunk)).hexdigest()


def _same(a: str, b: str) -> bool:
    return os.path.getsize(a) == os.path.getsize(b) and all(x == y for x, y in zip(_pieces(a), _pieces(b), strict=True))


def _or_none(f, *args):
    if None in args:
        return None
    try:
        return f(*args)
    except (OSError, ValueError):  # unequal numbers of pieces: a file changed while it was read
        return None


def partial_digest(path, head_only: bool, chunk: int):
    """The digest of a file's head and tail, which alone are read; null if it can't be read."""
    return F.pandas_udf(lambda paths: paths.map(lambda x: _or_none(_partial, x, head_only, chunk)), "string")(path)


def full_digest(path):
    """The digest of a file of any size, a block at a time; null if it can't be read."""
    return F.pandas_udf(lambda paths: paths.map(lambda x: _or_none(_full, x)), "string")(path)


def same_bytes(path, other):
    """Whether two files of any size are equal, a block at a time; null if one can't be read."""
    return F.pandas_udf(lambda a, b: pd.Series([_or_none(_same, x, y) for x, y in zip(a, b, strict=True)], dtype=object), "boolean")(path, other)


def unread(entries: DataFrame) -> DataFrame:
    """``(path, error)`` of the files that can't be opened and read."""

    @F.pandas_udf("string")
    def tried(paths: pd.Series) -> pd.Series:
        def one(path):
            try:
                with open(path, "rb") as f:
                    f.read(1)
            except OSError as e:
                return _error(e)
            return None

        return paths.map(one)

    return entries.where("kind = 'File'").select("path", tried("path").alias("error")).where("error IS NOT NULL")


def locked(entries: DataFrame) -> DataFrame:
    """``entries`` with ``locked``: whether a file can't be opened for writing for want of permission."""

    @F.pandas_udf("boolean")
    def tried(paths: pd.Series) -> pd.Series:
        def one(path):
            try:
                with open(path, "r+b"):
                    return False
            except PermissionError:
                return True
            except OSError:
                return False

        return paths.map(one)

    return entries.withColumn("locked", F.when(F.col("kind") == "File", tried("path")))


def with_content(entries: DataFrame, most: int = 1 << 26) -> DataFrame:
    """``entries`` with the ``content`` of files of at most ``most`` bytes, else null."""

    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        def one(path):
            try:
                if os.path.getsize(path) <= most:
                    with open(path, "rb") as f:
                        return f.read()
            except OSError:
                pass
            return None

        return paths.map(one)

    return entries.withColumn("content", F.when(F.col("kind") == "File", read("path")))
