"""Structured Streaming: hashing what arrives, first sightings, counts by window.

These go beyond a batch scan: a folder that grows is hashed once, file by file, across runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import state


def append_digests(stream: DataFrame, cache_path: str, checkpoint: str, content: str = "content"):
    """A started query that appends a digest to the table at ``cache_path`` for each file not in it yet.

    ``stream`` has ``physical_key``, ``size_bytes``, ``mtime_ns``, ``ctime_ns`` and the
    content. A batch that runs again after a failure finds its own rows and adds none.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256)).withColumn("created_at", F.unix_seconds(F.current_timestamp()))
        keyed = keyed.select("physical_key", "size_bytes", "mtime_ns", "ctime_ns", "digest", "created_at").dropDuplicates(["physical_key", "size_bytes", "mtime_ns"])
        try:
            known = spark.read.parquet(cache_path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        if known is not None:
            keyed = keyed.join(known.select("physical_key", "size_bytes", "mtime_ns").distinct(), ["physical_key", "size_bytes", "mtime_ns"], "left_anti")
        keyed.write.mode("append").parquet(cache_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_digests(spark, cache_path: str) -> DataFrame:
    """The latest digest of each file."""
    return state.latest(spark.read.parquet(cache_path), ["physical_key", "size_bytes"])


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks want times with a zone; those without are taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_seen(stream: DataFrame, keys: list[str], time: str, within: str = "30 days") -> DataFrame:
    """The first sighting of each key; state older than ``within`` is dropped."""
    return _timed(stream, time).withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window; a window is given out when no event within ``late`` can change it."""
    window = F.window(time, size)
    return _timed(stream, time).withWatermark(time, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
