"""Moving files into quarantine and back, and purging them: the one place where files are touched.

A plan is a table; ``move``, ``restore`` and ``purge`` carry it out and return events, which
are appended to the journal. Each is safe to run again: a task that Spark repeats finds what
it did before and reports it alike. Folders must be reachable from all executors.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths, text
from gleaner.operators import state

EVENTS = "id string, path string, quarantine_path string, size_bytes long, session_id string, reason string, event string, at string, purge_at string, error string"


def planned(plan: DataFrame, folder: str) -> DataFrame:
    """Rows ``move`` works on, of those of ``session_plan`` to be put aside: where each file goes, and its id.

    ``plan`` has ``path``, ``size_bytes``, ``session_id``, ``reason``, ``at`` and ``purge_at``.
    """
    mark = F.substring(F.sha2(F.concat_ws(":", "session_id", "path").cast("binary"), 256), 1, 16)
    to = F.concat_ws("/", F.lit(folder.rstrip("/")), "session_id", F.concat_ws("_", mark, paths.file_name(F.col("path"))))
    return plan.where("action = 'quarantine'").select(
        F.concat_ws(":", "session_id", mark).alias("id"), "path", to.alias("quarantine_path"), F.col("size_bytes").cast("long").alias("size_bytes"), "session_id", "reason", "at", "purge_at"
    )


def _carried(rows: DataFrame, event: str, act) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for path, held in zip(pdf["path"], pdf["quarantine_path"], strict=True):
                try:
                    errors.append(act(path, held))
                except OSError as e:
                    errors.append(type(e).__name__)
            yield pdf.assign(event=[event if e is None else "failed" for e in errors], error=errors)[[c.split()[0] for c in EVENTS.split(", ")]]

    return rows.select("id", "path", "quarantine_path", "size_bytes", "session_id", "reason", "at", "purge_at").mapInPandas(run, EVENTS)


def _put(source: str, target: str) -> str | None:
    """Renames, or copies whole and then removes where the file system is another one; never overwrites."""
    if os.path.lexists(target):
        return None if not os.path.lexists(source) else "FileExistsError"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.rename(source, target)
    except OSError as e:
        if not os.path.lexists(source):
            return type(e).__name__
        part = f"{target}.part"
        shutil.copy2(source, part, follow_symlinks=False)
        os.rename(part, target)
        os.unlink(source)
    return None


def move(rows: DataFrame) -> DataFrame:
    """Events of moving files into quarantine."""
    return _carried(rows, "moved", _put)


def restore(rows: DataFrame) -> DataFrame:
    """Events of moving them back; a file that took the place meanwhile is left there."""
    return _carried(rows, "restored", lambda path, held: _put(held, path))


def purge(rows: DataFrame) -> DataFrame:
    """Events of deleting them for good."""

    def act(path, held):
        if os.path.lexists(held):
            os.unlink(held)

    return _carried(rows, "purged", act)


def at_time(rows: DataFrame, now: int) -> DataFrame:
    return rows.withColumn("at", text.clock(F.lit(now)))


class Journal:
    """An append-only table of events; what is in quarantine are the entries whose last event moved them there."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def append(self, events: DataFrame) -> None:
        """Events as they happen: carried out when written, once for each attempt of a task."""
        events.write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(self.path)

    def active(self) -> DataFrame:
        done = self.events().where("event <> 'failed'")
        return state.active(done.select([c.split()[0] for c in EVENTS.split(", ")]))

    def move(self, plan: DataFrame, folder: str) -> None:
        self.append(move(planned(plan, folder)))

    def restore(self, now: int, reason: str | None = None, ids: list[str] | None = None) -> None:
        """Everything, or what has a reason like a pattern, or some ids."""
        rows = self.active()
        rows = rows.where(F.col("reason").like(reason)) if reason is not None else rows
        rows = rows.where(F.col("id").isin(ids)) if ids is not None else rows
        self.append(restore(at_time(rows, now)))

    def purge(self, now: int, session: str | None = None, everything: bool = False) -> None:
        """What is due, or a whole session, or everything."""
        rows = self.active()
        if session is not None:
            rows = rows.where(F.col("session_id") == session)
        elif not everything:
            rows = state.expired(rows, text_clock(self.spark, now))
        self.append(purge(at_time(rows, now)))


def text_clock(spark, now: int) -> str:
    return spark.range(1).select(text.clock(F.lit(now))).first()[0]
