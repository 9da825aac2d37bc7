"""Line deduplication across documents, in DataFrame functions only.

Lines are exploded, reduced to a 128-bit hash of their normalised key, and counted over
distinct documents; the lines to drop come back as positions, and a text is put together
again from the slices between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, ascii_lower, table


#: Places that the rows of one key are dealt to.
SALTS = 8


def line_key(line):
    """The line without blanks at its ends, A-Z lowered."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``(id, mark, drop)``: the sorted positions (from 0) of the lines that each document loses.

    A key of at least ``min_chars`` code points that occurs in at least ``min_docs``
    distinct documents keeps its lines only in the largest ``doc_id`` that holds it.
    ``mark`` hashes the text, so that rows that share an id but differ in text are told
    apart; rows without an id are not counted and lose nothing.
    """
    source = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("body")
    ).where(F.col("id").isNotNull())
    lines = source.select("id", F.xxhash64("body").alias("mark"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    keys = (
        lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # Distinct (key, document) first, then a count that is combined before its shuffle: a key
    # that a third of all rows hold adds one row for each map task.
    held = keys.select("h1", "h2", "id").distinct()
    common = (
        held.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # A common key is met in SALTS places, by documents, and adaptive execution may split each of them again.
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["h1", "h2", "salt"])
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id", "mark")
        .agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and ``n_lines``, ``n_dropped`` (long).

    A null or empty text is one empty line, and stays as it is. An empty table gives an
    empty result; other columns pass through, whatever their names, but for two that are
    called ``n_lines`` and ``n_dropped``, which are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = repeated_lines(docs, min_chars, min_docs).select(
        F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("drop").alias("__drop")
    )
    body = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(
        drops.hint("shuffle_hash"),
        (docs["doc_id"] == drops["__id"]) & (F.xxhash64(body) == drops["__mark"]),
        "left",
    ).withColumn("__lines", F.split(body, "\n", -1))
    starts = F.concat(F.array(F.lit(0)), F.transform("__drop", lambda p: p + 1))
    ends = F.concat(F.col("__drop"), F.array(F.size("__lines")))
    rest = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(F.col("__lines"), s + 1, e - s)))
    columns = [
        (F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"))
        if c == "text"
        else F.col(f"`{c}`")
        for c in kept
    ]
    return joined.select(
        *columns,
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )


def query(spark, sf_dir):
    """``op7_line_dedup``: what every text of ``documents`` keeps."""
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.pos, l.line, (c.key IS NOT NULL AND c.keeper <> l.doc_id) AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
