"""Progress and cancellation of what runs: Spark's own tags, trackers and listeners.

A stage that is cancelled raises ``Interrupted`` and returns nothing, so no group is ever
told without some of its members.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: The stages of a whole scan, in order.
STAGES = ("discovery", "sizes", "partial", "full", "compared", "similar", "hygiene", "report")


class Interrupted(RuntimeError):
    """A stage was cancelled before its end."""


class Run:
    """A cancellable run; ``events`` are (stage, what) as they happen, also given to ``told``."""

    def __init__(self, spark: SparkSession, told: Callable[[str, str], None] | None = None):
        self.spark, self.tag, self.told = spark, f"gleaner-{uuid.uuid4().hex}", told
        self.cancelled, self.events = False, []

    def _tell(self, stage: str, what: str) -> None:
        self.events.append((stage, what))
        if self.told:
            self.told(stage, what)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Jobs started inside belong to the run; a cancelled one ends them and raises ``Interrupted``."""
        if self.cancelled:
            raise Interrupted(name)
        self._tell(name, "started")
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield
        except Exception as e:
            self._tell(name, "cancelled" if self.cancelled else "failed")
            if self.cancelled:
                raise Interrupted(name) from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        if self.cancelled:
            self._tell(name, "cancelled")
            raise Interrupted(name)
        self._tell(name, "ended")

    def cancel(self) -> None:
        """From any thread."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks in all of the active stages."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)


class StreamProgress(StreamingQueryListener):
    """Keeps the rows that each batch of a stream took in; ``told`` hears of them."""

    def __init__(self, told: Callable[[str, int], None] | None = None):
        self.told, self.rows, self.ended = told, [], []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows.append((event.progress.name, event.progress.numInputRows))
        if self.told:
            self.told(event.progress.name, event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.append((str(event.id), event.exception))
