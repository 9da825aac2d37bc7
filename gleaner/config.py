"""What is remembered between runs on the driver: quarantine folders, and the folders people start from."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths

#: Fixed values. Standard folders: name, colour, icon.
COMMON = (
    ("Documents", "#059669", "documents"), ("Pictures", "#2563EB", "photos"), ("Videos", "#7C3AED", "videos"),
    ("Music", "#DC2626", "music"), ("Downloads", "#D97706", "downloads"), ("Desktop", "#0891B2", "desktop"),
)


class QuarantineFolders:
    """The folders that hold quarantined files, in the order they came up; those that are gone are left out."""

    def __init__(self, path: str):
        self.path = Path(path)

    def list(self) -> list[str]:
        try:
            found = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return []
        known = found.get("quarantine_dirs")
        if not isinstance(known, list):
            known = [found.get("last_quarantine_dir")]  # as an older version kept it
        return [d for d in known if isinstance(d, str) and os.path.exists(d)]

    def last(self) -> str | None:
        return next(reversed(self.list()), None)

    def _write(self, folders: list[str]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps({"quarantine_dirs": folders}))
        os.replace(part, self.path)

    def add(self, folder: str) -> None:
        known = self.list()
        self._write([d for d in (known if folder in known else [*known, folder]) if os.path.exists(d)])

    def remove(self, folder: str) -> None:
        self._write([d for d in self.list() if d != folder])


def common_folders(entries: DataFrame) -> DataFrame:
    """``(name, path, color, icon, size)`` of the standard folders in an inventory; ``size`` tells how many entries lie right in them."""
    name = paths.file_name(F.col("path"))
    known = entries.where((F.col("kind") == "Directory") & name.isin(*[c[0] for c in COMMON])).select("path", name.alias("name")).distinct()
    inside = entries.select(paths.parent(F.col("path")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for c in COMMON for x in (c[0], c[i])]), F.col("name"))
    size = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" items"))).otherwise("")
    return known.join(inside, "path", "left").select("name", "path", pick(1).alias("color"), pick(2).alias("icon"), size.alias("size"))


def belongs(path: str, roots: list[str]) -> str | None:
    """The first of ``roots`` that a path starts with, as an interrupted scan is found again."""
    return next((r for r in roots if path.startswith(r)), None)
