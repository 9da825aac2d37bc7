"""Kinds of files by extension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dictionaries as D
from gleaner.functions import paths


def category(path):
    ext = paths.lower_extension(path)
    return reduce(lambda out, x: F.when(ext.isin(*x[1]), x[0]).otherwise(out), reversed(D.CATEGORIES), F.lit("Other"))


def similar_candidates(entries: DataFrame, extensions=D.IMAGE_EXTENSIONS) -> DataFrame:
    """What a detector for these extensions looks at: files of some bytes."""
    return entries.where((F.col("size_bytes") > 0) & paths.lower_extension(F.col("path")).isin(*extensions))
