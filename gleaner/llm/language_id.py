"""Language identification by compression.

A raw-content zstandard dictionary is made for each label from a bounded sample of labelled
texts. A whole text is compressed in blocks with every dictionary; the label whose
dictionary makes it smallest wins, and a narrow win is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import table

UNKNOWN = "und"
_NOISE = re.compile(r"[^\w]+|[\d_]+")
LEVEL = 5
#: Bytes compressed at once: short enough that the dictionary, not the text itself, is what helps.
BLOCK = 2048


def letters(text: str) -> bytes:
    """The text's words in lower case, digits and signs left out."""
    return _NOISE.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def is_training(doc_id):
    """Documents whose crc32 of the decimal id leaves no remainder of 1 by 3."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1


def dictionaries(docs: DataFrame, pieces: int = 256, piece_chars: int = 256, labels: int = 200) -> dict[str, bytes]:
    """A dictionary for each of the ``labels`` commonest labels, of at most ``pieces`` excerpts of ``piece_chars`` code points.

    Labelled training documents are spread over ``pieces`` slots by a hash of their id; the
    smallest hash of a slot gives its excerpt, from a place that the hash chooses too. What
    reaches the driver is bounded by ``labels`` times ``pieces``; of labels as common the
    smaller come first. Documents of further labels teach nothing, and are judged by the others.
    """
    rows = docs.where(is_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(labels)
    rows = rows.join(F.broadcast(common.select("lang")), "lang", "left_semi")  # as many rows as labels at most
    slot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(pieces))
    rank = F.xxhash64(F.lit(11), F.col("doc_id"))
    chosen = rows.groupBy(F.col("lang"), slot.alias("slot")).agg(F.min(rank).alias("rank"))
    at = F.pmod(F.col("rank"), F.greatest(F.length("text") - piece_chars + 1, F.lit(1)))
    # At most ``labels`` x ``pieces`` rows of three short columns, so the broadcast has a fixed bound.
    taken = (
        rows.select("lang", slot.alias("slot"), rank.alias("rank"), "text")
        .join(F.broadcast(chosen), ["lang", "slot", "rank"], "left_semi")
        .select("lang", "slot", F.col("text").substr((at + 1).cast("int"), F.lit(piece_chars)).alias("x"))
        .groupBy("lang", "slot")
        .agg(F.min("x").alias("x"))
        .collect()
    )
    found: dict[str, list] = {}
    for r in sorted(taken, key=lambda r: (r.lang, r.slot)):
        found.setdefault(r.lang, []).append(letters(r.x))
    return {lang: b" ".join(xs) for lang, xs in found.items() if any(xs)}


class Classifier:
    """Compressors with one dictionary each; holds nothing but bytes until first used."""

    def __init__(self, found: dict[str, bytes]):
        self.labels = sorted(found)
        self.found = found
        self.tools = None

    def _ready(self):
        if self.tools is None:
            self.tools = []
            for label in self.labels:
                d = zstandard.ZstdCompressionDict(self.found[label], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.tools.append(
                    zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
                )
        return self.tools

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(tool.compress(b)) for b in blocks) for tool in self._ready()]

    def judge(self, text) -> tuple[str, float, float]:
        """``(label, score, margin)``; ``und``, 0, 0 without a letter or without anything learned."""
        data = letters(text) if isinstance(text, str) else b""
        if not data or not self.labels or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        return self.labels[order[0]], margin / (margin + 0.05) if margin else 0.0, margin

    def __getstate__(self):
        return {"labels": self.labels, "found": self.found, "tools": None}


def language_id(docs: DataFrame, found: dict[str, bytes], min_margin: float = 0.01) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted``.

    Whole texts are judged, one by one; a null text, or one without a letter, is ``und``
    with a score of 0. A tie or a margin under ``min_margin`` (of the smallest size against
    the next) is not accepted. Repeated rows are judged alike; columns of these four names
    are replaced, all others pass through.
    """
    tool = Classifier(found)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([tool.judge(t) for t in texts], columns=["lang_pred", "score", "margin"])

    new = ("lang_pred", "score", "margin", "accepted")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    out = docs.select(*kept, judged(F.col("text")).alias("__judged")).select(*kept, "__judged.*")
    return out.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= min_margin))


def query(spark, sf_dir):
    """``op2_language_id``: the language of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = language_id(docs.select("doc_id", "text"), dictionaries(docs))
    return out.select(
        "doc_id", F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted"
    )
