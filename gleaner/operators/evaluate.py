"""How well groups found agree with groups known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of one group in both, in either, and precision, recall and F1, in one row.

    ``found(id, group_id)`` and ``truth(id, group_id)``; pairs are counted from the sizes of
    groups and of their overlaps, and never made.
    """
    pairs = lambda n: F.sum(n * (n - 1) / 2).cast("long")
    a, b = found.select("id", F.col("group_id").alias("a")), truth.select("id", F.col("group_id").alias("b"))
    counted = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(pairs(F.col("n")), F.lit(0)).alias("p"))
    one = counted(a, "a").select(F.col("p").alias("found_pairs"))
    two = counted(b, "b").select(F.col("p").alias("true_pairs"))
    both = counted(a.join(b, "id"), "a", "b").select(F.col("p").alias("common_pairs"))
    row = one.join(F.broadcast(two)).join(F.broadcast(both))  # one row each
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(1.0)
    row = row.withColumns({"precision": F.round(ratio(F.col("common_pairs"), F.col("found_pairs")), 9), "recall": F.round(ratio(F.col("common_pairs"), F.col("true_pairs")), 9)})
    total = F.col("precision") + F.col("recall")
    return row.withColumn("f1", F.round(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), 6))
