"""Trees of files with known duplicates, to measure what is found.

``plan`` tells the files, ``contents`` makes their bytes; both are arithmetic on the row
number, so that any executor makes the same file again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPIES = 3
GROUPS, UNIQUE = 6, 20
#: Junk beside them: name and bytes.
JUNK = (("Thumbs.db", 16), ("empty.txt", 0), ("draft.tmp", 12), ("~$lock.docx", 8))


def words(seed: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of a SplitMix64 generator."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def plan(spark: SparkSession, scale: int = 1) -> DataFrame:
    """``(path, kind, cluster, seed, size_bytes)``: groups of exact copies, unique files, and junk in every folder."""
    n = F.col("id")
    exact = spark.range(scale * GROUPS * COPIES).select(
        F.concat(F.lit("exact/"), (n % COPIES).cast("string"), F.lit("/doc_"), F.floor(n / COPIES).cast("string"), F.lit(".bin")).alias("path"), F.lit("exact").alias("kind"),
        F.floor(n / COPIES).alias("cluster"), (F.floor(n / COPIES) + 1).alias("seed"), (1000 + F.floor(n / COPIES) * 997 % 50_000).alias("size_bytes"),
    )
    alone = spark.range(scale * UNIQUE).select(
        F.concat(F.lit("unique/doc_"), n.cast("string"), F.lit(".bin")).alias("path"), F.lit("unique").alias("kind"), F.lit(None).cast("long").alias("cluster"),
        (n + 1_000_000).alias("seed"), (1000 + n * 997 % 50_000).alias("size_bytes"),
    )
    names = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("size")) for a, b in JUNK])
    junk = spark.range(scale).select(n, F.explode(names).alias("j")).select(
        F.concat(F.lit("junk/"), n.cast("string"), F.lit("/"), F.col("j.name")).alias("path"), F.lit("hygiene").alias("kind"), F.lit(None).cast("long").alias("cluster"),
        (n + 2_000_000).alias("seed"), F.col("j.size").cast("long").alias("size_bytes"),
    )
    return exact.unionByName(alone).unionByName(junk)


def counts(found: DataFrame) -> DataFrame:
    """``(kind, files, clusters, bytes)`` of a plan."""
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("cluster").alias("clusters"), F.sum("size_bytes").alias("bytes"))


def content(seed: int, size: int) -> bytes:
    return words(seed, -(-size // 8)).astype("<u8").tobytes()[:size]


def written_tree(found: DataFrame, folder: str) -> DataFrame:
    """Writes the files of a plan below ``folder``, which all executors reach; ``(path, size_bytes)`` of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, seed, size in zip(pdf["path"], pdf["seed"], pdf["size_bytes"], strict=True):
                to = os.path.join(folder, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "wb") as f:
                    f.write(content(int(seed), int(size)))
            yield pdf[["path", "size_bytes"]]

    return found.select("path", "seed", "size_bytes").mapInPandas(run, "path string, size_bytes long")
