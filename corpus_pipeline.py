"""A training-data pipeline: language, repeated lines, near duplicates, secrets, sequences.

Each stage works on all that the one before kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import jaccard_join, language_id, line_dedup, packing, secret_scan
from gleaner.llm.common import table, written


def known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier settles; it learns from the labels of ``docs``.

    A text that is null, empty or without a letter has no language and goes; one whose two
    best languages are nearly as good, or tie, goes too. A null id or label is no obstacle: such
    rows teach nothing and are judged. Whole texts are judged, however long; rows that
    repeat are judged alike. With no labels at all nothing is settled. An empty table stays
    empty. Columns of any name pass through.
    """
    found = language_id.dictionaries(docs)
    judged = language_id.language_id(docs.select("text", F.struct("*").alias("row")), found)
    return judged.where("accepted").select("row.*")


def without_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that at least five of them share, but in the last of these.

    All rows stay. A null or empty text stays as it is; a row without an id is not counted
    and loses nothing; rows that repeat an id count once and lose the same lines. A text of
    nothing but such lines becomes empty. Columns of any name pass through; ``n_chars``
    follows the text.
    """
    return _with_text(line_dedup.line_dedup(_rows(docs)), docs)


def without_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: 5-word shingles, similarity 0.8 or more.

    The one of the smallest id stays, null ids coming last. Null texts and texts without
    words are like nothing and stay, every one; of rows that repeat an id and a text with
    words one stays. Very long texts are compared whole. Columns of any name pass through.
    """
    return jaccard_join.representatives(docs, 5, 80)


def without_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark.

    All rows stay, and texts without secrets as they are, null and empty ones too.
    Overlapping secrets become one mark. Rows that repeat are cleaned alike. Columns of any
    name pass through; ``n_chars`` follows the text.
    """
    found = secret_scan.secret_scan(_rows(docs))
    return _with_text(found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans"))), docs)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens, as ``op5_packing`` returns them.

    A null or empty text is one piece of one token; long texts are several pieces; rows
    that repeat are packed each. Without documents there are no sequences.
    """
    from public_tokenizers import path

    out = packing.pack(packing.pieces(docs, path("byte_bpe_50k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _rows(docs: DataFrame) -> DataFrame:
    """What stages look at, beside ``row``, the document without its text: its other columns meet none of theirs."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _with_text(found: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with the text that was found, and ``n_chars`` as long as that is."""
    new = {"text": F.col("text")}
    if "n_chars" in like.columns:
        kind = like.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(kind)
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in like.columns])


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("sequences", packed),
]

#: SQL can't express compression, the randomness tests or the packing; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
