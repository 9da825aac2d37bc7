"""One object for the questions people ask of an inventory."""

from __future__ import annotations

import time
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dictionaries as D
from gleaner.operators import detectors, exact, hygiene, keeper, protection, review
from gleaner.sources import folders


@dataclass
class Options:
    """Defaults of a scan; ``from_toml`` reads the same names from a file."""

    language: str = "en"
    purge_days: int = 30
    mode: str = "exact"
    head_only: bool = False
    verify: str = "cached_only"
    strategy: str = "smart"
    excludes: tuple = D.DEFAULT_EXCLUDES + D.PROTECTED_PATHS
    weights: dict = field(default_factory=dict)

    @classmethod
    def from_toml(cls, path: str) -> Options:
        with open(path, "rb") as f:
            found = tomllib.load(f)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in cls.__dataclass_fields__})


class Engine:
    """Scans of ``entries``: an inventory as ``gleaner.sources`` makes them."""

    def __init__(self, entries: DataFrame, options: Options | None = None, now: int | None = None):
        self.options = options or Options()
        self.entries = protection.without_excluded(entries, self.options.excludes)
        self.now = int(now if now is not None else time.time())

    @classmethod
    def over_folders(cls, spark: SparkSession, roots, options: Options | None = None, **walk) -> Engine:
        options = options or Options()
        entries, _ = folders.discover(spark, roots, exclude_prefixes=",".join(options.excludes), **walk)
        # Without contents: what is still a candidate is read where it lies, whatever its size.
        return cls(entries, Options(**{**options.__dict__, "excludes": ()}))

    def scan(self, stage: str = "summary") -> DataFrame:
        """``summary``, ``candidates``, ``partial``, ``full`` or ``compared``."""
        return {
            "summary": exact.discovery_summary, "candidates": exact.candidates, "partial": lambda e: exact.partial_members(e, self.options.head_only),
            "full": lambda e: exact.full_members(e, self.options.head_only), "compared": lambda e: exact.confirmed_members(e, "always"),
        }[stage](self.entries)

    def unread(self) -> DataFrame:
        """``(path, error)`` of files that share their size with others and can't be read; no group has them."""
        return folders.unread(exact.candidates(self.entries).withColumn("kind", F.lit("File")))

    def exact(self, reference: str | None = None, roots=None, cached: DataFrame | None = None) -> DataFrame:
        """Members of exact groups with their keepers.

        With ``verify`` ``cached_only`` the groups that hold a path of ``cached(path)``, whose
        digest was not made in this run, are compared byte by byte, and no others.
        """
        cached = self.entries.select("path").limit(0) if cached is None else cached
        members = keeper.with_keeper(exact.confirmed_members(self.entries, self.options.verify, cached), self.entries, self.options.strategy)
        if reference:
            members = review.with_reference(members, reference)
        return review.across_roots(members, roots) if roots else members

    def hygiene(self) -> DataFrame:
        return hygiene.report(self.entries, self.now)

    def similar(self, pictures: DataFrame, mode: str = "mirror") -> DataFrame:
        """Groups of near duplicates among rows of Spark's ``image`` source, and their variants of this mode."""
        return detectors.Pictures.of_mode(mode).groups(pictures)

    def cleanup_plan(self, members: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        """What would be done with each member; ``seen`` is an earlier inventory to compare with."""
        changed = protection.changed_since(seen if seen is not None else self.entries, self.entries)
        return review.cleanup_plan(members, protection.classified(self.entries), changed)
