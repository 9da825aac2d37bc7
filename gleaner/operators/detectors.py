"""What a kind of near duplicate has to bring along to be searched for."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import bits, categories, images
from gleaner.functions import dictionaries as D
from gleaner.operators import similar, state
from gleaner.operators.tables import written


class Detector(ABC):
    """A detector fingerprints files and says how far apart two fingerprints may be.

    Fingerprints are structs of columns: ``p`` and ``d``, and ``blocks`` (the own block
    first, then those of variants) and ``within`` where there are variants.
    """

    name: str
    extensions: tuple = ()
    #: Part of the key of cached fingerprints: to be raised when their bits change.
    version: int = 1
    #: Whether files that belong together may look alike without being duplicates.
    gates: bool = False

    def params(self) -> str:
        """The settings that fingerprints depend on; part of their key in the cache."""
        return ""

    @abstractmethod
    def fingerprints(self, files: DataFrame) -> DataFrame:
        """``(id, p, d)`` of what it can read, and ``blocks`` and ``within`` if it has variants."""

    def variants(self, prints: DataFrame) -> DataFrame:
        """``(id, k, p, d)``: each variant of each fingerprint, 0 the own one."""
        if "blocks" not in prints.columns:
            return prints.select("id", F.lit(0).alias("k"), "p", "d")
        return prints.select("id", F.posexplode("blocks").alias("k", "v")).select("id", "k", "v.p", "v.d")

    def distance(self, x: Column, y: Column) -> Column:
        """Of the own blocks; a metric, as the join by bands wants it."""
        return bits.whole_distance(bits.block_distance(x, y))

    def variant_distance(self, variant: Column, y: Column) -> Column:
        """Of one file's variant and another's own block; that of variant 0 is ``distance``."""
        return self.distance(variant, y)

    def similarity(self, distance: Column) -> Column:
        return bits.similarity(distance.cast("double"))

    def limit(self) -> int:
        return bits.WIDEST

    def is_near(self, distance: Column) -> Column:
        return distance <= self.limit()

    def label(self, similarity: Column) -> Column:
        return bits.label(similarity)

    def keeper_score(self, files: DataFrame) -> DataFrame:
        """``(id, score)``: larger is better to keep; by default the larger file is."""
        return files.select("id", F.col("size_bytes").cast("double").alias("score"))

    def candidates(self, entries: DataFrame) -> DataFrame:
        """The entries it is asked about, one for each identity; none where there are fewer than two."""
        return similar.at_least_two(similar.once(categories.similar_candidates(entries, self.extensions)))

    def cached(self, files: DataFrame, cache: DataFrame) -> DataFrame:
        """``files`` with ``data``, ``error`` and ``cached``, as an earlier run of this detector with these settings left them."""
        return state.probe_fingerprints(files, cache, self.name, self.params(), self.version)

    def groups(self, files: DataFrame) -> DataFrame:
        prints = self.fingerprints(files)
        named = prints.select("id", F.col("id").alias("path")) if self.gates else None
        return similar.near_groups(prints, self.limit(), named)


class Pictures(Detector):
    """Perceptual fingerprints of rows of Spark's ``image`` source."""

    name, extensions, version, gates = "image-phash", D.IMAGE_EXTENSIONS, images.VERSION, True

    def __init__(self, mode: str = "mirror"):
        self.mode = mode

    @classmethod
    def of_mode(cls, started: str) -> Pictures:
        """The detector of the mode that begins so, in any case: ``f`` is ``full``."""
        found = [m for m in images.MODES if started and m.startswith(started.lower())]
        if len(found) != 1:
            raise ValueError(f"mode is one of {images.MODES}")
        return cls(found[0])

    def params(self) -> str:
        return self.mode

    def fingerprints(self, files: DataFrame) -> DataFrame:
        first, side = F.element_at("blocks", 1), F.col("min_side")
        made = images.fingerprints(files, self.mode).where("error IS NULL")
        return written(made.select(F.col("path").alias("id"), first["p"].alias("p"), first["d"].alias("d"), "blocks", bits.limit(side, side).alias("within")), "pictures")

    def keeper_score(self, files: DataFrame) -> DataFrame:
        return images.keeper_scores(files).select("id", F.col("total").alias("score"))


class Texts(Detector):
    """Majority fingerprints of the words of ``(doc_id, text)``."""

    name = "text-simhash"

    def fingerprints(self, files: DataFrame) -> DataFrame:
        return similar.simhash(files).select(F.col("doc_id").alias("id"), "p", "d")


DETECTORS = {d.name: d for d in (Pictures, Texts)}


def register(spark) -> None:
    """The distances as functions of Spark SQL, which Catalyst sees through, and ``variants`` as a table function."""
    from pyspark.sql.functions import udtf

    whole = "CAST(least(64, ceil(bit_count(p ^ q) + 0.7D * bit_count(d ^ e))) AS INT)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION print_distance(p BIGINT, d BIGINT, q BIGINT, e BIGINT) RETURNS INT RETURN {whole}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION print_similarity(distance INT) RETURNS DOUBLE RETURN 1 - least(distance, 64) / 64D")

    @udtf(returnType="k int, p bigint, d bigint")
    class Variants:
        def eval(self, blocks):
            for k, block in enumerate(blocks or ()):
                yield k, block["p"], block["d"]

    spark.udtf.register("variants", Variants)
