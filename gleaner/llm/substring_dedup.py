"""Substring deduplication over windows of words, by super-k-mer partitioning.

Consecutive windows that share a minimiser travel to the minimiser's bucket as one packed
string of words. Equal windows always share it, so a bucket that sorts its windows counts
them exactly. The minimiser is the rarest of a window's short runs of words, by counters
over all texts; windows that have none but common ones travel alone and are dealt by their
hashes. Windows that repeat within a chunk of documents are settled there, so that what a
passage common to many documents sends to its bucket is one string a chunk. Words are
compared by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import table

WINDOW = 20
#: Words that a minimiser spans.
MER = 3
#: Bytes of text dealt with at once on the map side, and what a bucket holds on average.
CHUNK = 6 << 20
BUCKET = 8 << 20
#: Partitions that buckets are dealt to at most.
PLACES = 1 << 16
#: Bytes whose words are hashed at once: what a worker holds for it is some 30 times as much.
SLICE = 1 << 20
#: Counters of the frequencies of runs, as powers of two: fewest and most, and the bytes of text for which there is one.
COUNTERS = (16, 20)
COUNTED = 1 << 18
#: Bytes that a window brings to its bucket, about; a run whose windows are well over a bucket's is common.
BROUGHT = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _tables or len(_tables[0]) <= n:
        size = max(n + 1, SLICE + (SLICE >> 1))
        _tables[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _tables.append(np.multiply.accumulate(out))
    return _tables


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans of ``values`` that do not depend on where they lie."""
    power, inverse = _powers(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=prefix[1:])
    return _mixed((prefix[end] - prefix[start]) * inverse[start])


def words_of(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a text with one blank between them."""
    data = np.frombuffer(buffer, np.uint8)
    blanks = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, side="right")))
        low = start[at]
        out[at:to] = _spans(data[low : end[to - 1]].astype(np.uint64) + np.uint64(1), start[at:to] - low, end[at:to] - low)
        at = to
    return out, start, end


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n``."""
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (n - size)], out[n - size :]) if n > size else out


def later(hashes: np.ndarray, windows: np.ndarray, k: int, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a window, given by its first word's place, equals one of a smaller (id, start).

    Windows are sorted by hash; those of equal hash are compared word by word with the
    first, and should two differ after all, every window is sorted by its words.
    """
    if not len(windows):
        return np.zeros(0, bool)
    key = _spans(hashes, windows, windows + k)
    order = np.lexsort((starts, ids, key))
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    for attempt in range(2):
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        check = np.flatnonzero(same)
        differ = np.zeros(len(check), bool)
        for j in range(k):
            differ |= hashes[windows[order[check]] + j] != hashes[windows[order[head[check]]] + j]
        if attempt or not differ.any():
            break
        order = np.lexsort((starts, ids, *(hashes[windows + j] for j in range(k - 1, -1, -1))))
        same = np.concatenate([[False], np.logical_and.reduce([hashes[windows[order[1:]] + j] == hashes[windows[order[:-1]] + j] for j in range(k)])])
    first = order[head]
    out = np.zeros(len(windows), bool)
    out[order] = same & ((ids[order] > ids[first]) | (starts[order] > starts[first]))
    return out


def _runs(flags: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of true ``flags``; ``joined`` says which go on from the one before."""
    on = flags & np.concatenate([[False], flags[:-1]]) & joined
    first = np.flatnonzero(flags & ~on)
    ends = flags & ~np.concatenate([on[1:], [False]])
    return first, np.flatnonzero(ends)


def mers_of(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of ``MER`` words."""
    return _mixed(_spans(hashes, np.arange(len(hashes) - MER + 1), np.arange(MER, len(hashes) + 1))) if len(hashes) >= MER else hashes[:0]


class Frequencies:
    """How common runs of words are, by counters that their lowest bits name."""

    def __init__(self, times: np.ndarray):
        self.bits = int(len(times)).bit_length() - 1
        self.rank = np.empty(len(times), np.uint32)
        self.rank[np.argsort(times, kind="stable")] = np.arange(len(times), dtype=np.uint32)
        common = BUCKET // BROUGHT + 4 * int(times.sum()) // len(times)
        self.parts = np.where(times > common, times * BROUGHT // BUCKET + 1, 1).astype(np.uint32)

    def places(self, mers: np.ndarray) -> np.ndarray:
        return (mers & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def ordered(self, mers: np.ndarray) -> np.ndarray:
        """Numbers that stand for the runs one to one, rare ones first."""
        return (self.rank[self.places(mers)].astype(np.uint64) << np.uint64(64 - self.bits)) | (mers >> np.uint64(self.bits))

    def split(self, ordered: np.ndarray) -> np.ndarray:
        """The parts that the windows of a run are dealt to, one but for common runs."""
        by_rank = np.empty_like(self.parts)
        by_rank[self.rank] = self.parts
        return by_rank[(ordered >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.uint64)


def frequencies(docs: DataFrame, total: int) -> Frequencies:
    """Counts over all texts of ``docs(text)``; at most two to the power of ``COUNTERS`` rows come to the driver."""
    size = 1 << min(COUNTERS[1], max(COUNTERS[0], (total // COUNTED).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, waiting, held = np.zeros(size, np.int64), [], 0

        def count():
            hashes = words_of(b" ".join(waiting))[0]
            np.add(times, np.bincount((mers_of(hashes) % np.uint64(size)).astype(np.int64), minlength=size), out=times)

        for batch in batches:
            for text in batch.column(0):
                waiting.append(b" ".join(text.as_py().encode("utf-8", "surrogatepass").split()))
                held += len(waiting[-1]) + 1
                if held >= SLICE:
                    count()
                    waiting, held = [], 0
        if waiting:
            count()
        some = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(times[some])], names=["place", "times"])

    out = np.zeros(size, np.int64)
    for place, times in docs.select("text").mapInArrow(run, "place long, times long").groupBy("place").agg(F.sum("times")).collect():
        out[place] = times
    return Frequencies(out)


class _Chunk:
    """Documents to be cut into super-k-mers together."""

    def __init__(self, k: int, buckets: int, common: Frequencies):
        self.k, self.buckets, self.common = k, buckets, common
        self.clear()

    def clear(self):
        self.texts, self.counts, self.docs, self.size = [], [], [], 0

    def add(self, doc: int, mark: int, text: str):
        words = text.encode("utf-8", "surrogatepass").split()
        if len(words) >= self.k:
            joined = b" ".join(words)
            self.texts.append(joined)
            self.counts.append(len(words))
            self.docs.append((doc, mark))
            self.size += len(joined)

    def rows(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, packed words, (id, mark, start, words) of each super-k-mer, settled intervals)."""
        if not self.texts:
            return
        k = self.k
        buffer = b" ".join(self.texts)
        hashes, at, to = words_of(buffer)
        counts = np.array(self.counts)
        docs = np.array(self.docs, dtype=np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        first_word = np.concatenate([[0], np.cumsum(counts)])
        windows = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
        own = owner[windows]
        starts = windows - first_word[own]
        gone = later(hashes, windows, k, docs[own, 0], starts)
        beside = np.concatenate([[False], windows[1:] == windows[:-1] + 1]) & np.concatenate([[False], own[1:] == own[:-1]])
        a, b = _runs(gone, beside)
        settled = np.stack([docs[own[a], 0], docs[own[a], 1], starts[a], starts[b] + k], axis=1) if len(a) else np.zeros((0, 4), np.int64)
        least = _least(self.common.ordered(mers_of(hashes)), k - MER + 1)[windows]
        parts = self.common.split(least)
        least = _mixed(least + _mixed(np.where(parts > 1, _spans(hashes, windows, windows + k) % parts, np.uint64(0))))
        cut = np.flatnonzero(~(beside & np.concatenate([[False], least[1:] == least[:-1]])))
        last = np.concatenate([cut[1:], [len(windows)]]) - 1
        needed = np.add.reduceat((~gone).astype(np.int64), cut) > 0
        cut, last = cut[needed], last[needed]
        bucket = (least[cut] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut, last, bucket = cut[order], last[order], bucket[order]
        packed = np.stack([docs[own[cut], 0], docs[own[cut], 1], starts[cut], last - cut + k], axis=1)
        left, right = at[windows[cut]].tolist(), to[windows[last] + k - 1].tolist()
        tool = zstandard.ZstdCompressor(level=1)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
        echo = settled.tobytes()
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            words = b" ".join([buffer[x:y] for x, y in zip(left[i:j], right[i:j], strict=True)])
            yield int(bucket[i]), tool.compress(words), tool.compress(packed[i:j].tobytes()), echo
            echo = b""
        self.clear()


def repeated_spans(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """``(id, mark, start, end)``: runs of words covered by windows that also start earlier.

    ``docs`` has ``id``, ``mark`` (a hash of the text) and ``text``.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    common = frequencies(docs, total)
    schema = pa.schema([("bucket", pa.int64()), ("words", pa.binary()), ("packed", pa.binary()), ("settled", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(k, buckets, common)

        def out():
            rows = list(chunk.rows())
            chunk.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else None

        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                chunk.add(doc, mark, text.as_py())
                if chunk.size >= CHUNK and (found := out()):
                    yield found
        if found := out():
            yield found

    def sort(rows: list[dict]) -> pa.RecordBatch:
        tool = zstandard.ZstdDecompressor()
        words, waiting, size = [], [], 0
        for row in rows:
            waiting.append(tool.decompress(row["words"]))
            size += len(waiting[-1])
            if size >= 4 << 20:
                words.append(words_of(b" ".join(waiting))[0])
                waiting, size = [], 0
        if waiting:
            words.append(words_of(b" ".join(waiting))[0])
        hashes = np.concatenate(words)
        packed = np.concatenate([np.frombuffer(tool.decompress(row["packed"]), np.int64).reshape(-1, 4) for row in rows])
        counts = packed[:, 3]
        spans = counts - k + 1
        own = np.repeat(np.arange(len(packed)), spans)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(spans) - spans, spans)
        windows = (np.cumsum(counts) - counts)[own] + inner
        starts = packed[own, 2] + inner
        gone = later(hashes, windows, k, packed[own, 0], starts)
        a, b = _runs(gone, inner > 0)
        found = np.stack([packed[own[a], 0], packed[own[a], 1], starts[a], starts[b] + k], axis=1)
        found = np.concatenate([found, *(np.frombuffer(row["settled"], np.int64).reshape(-1, 4) for row in rows if row["settled"])])
        return pa.RecordBatch.from_arrays([pa.array(found[:, i], pa.int64()) for i in range(4)], names=["id", "mark", "start", "end"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield sort(held)
                    held = []
                held.append(row)
        if held:
            yield sort(held)

    # A partition for each bucket, or for each of some that are sorted: left to hashes of the
    # buckets' numbers, a few partitions would get several.
    places = min(buckets, PLACES)
    rows = docs.mapInArrow(cut, "bucket long, words binary, packed binary, settled binary").repartitionById(places, (F.col("bucket") % places).cast("int"))
    return rows.sortWithinPartitions("bucket").mapInArrow(meet, "id long, mark long, start long, end long")


_LEAST = -(1 << 63)


def substring_dedup(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and ``n_words``, ``n_removed`` (long).

    Words are runs of anything but ASCII blanks; those covered by a window of ``k`` words
    that also starts earlier (smaller ``doc_id``, or same document and earlier) go, and
    the others are joined by one blank. A null text has no words and becomes empty. A null
    id counts as the smallest. Rows that repeat an id and a text lose the same words, none
    of them to each other. Columns called ``n_words`` and ``n_removed`` are replaced.
    """
    identity = F.coalesce(F.col("doc_id"), F.lit(_LEAST)).alias("id")
    source = docs.where(F.col("text").isNotNull()).select(identity, F.xxhash64("text").alias("mark"), "text")
    spans = (
        repeated_spans(source, k)
        .groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
        .agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("__spans"))
    )

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for text, cuts in zip(texts, found, strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                n = len(words)
                if cuts is not None:
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, np.asarray(cuts[::2]), 1)
                    np.add.at(marks, np.asarray(cuts[1::2]), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(marks)[:n] == 0).tolist()]
                out.append((b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words)))
            yield pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])

    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    # Both sides of the spans' join hold one row a document; only the spans are built into a table.
    joined = docs.withColumn("__doc", F.coalesce(F.col("doc_id"), F.lit(_LEAST))).join(
        spans.hint("shuffle_hash"), (F.col("__doc") == F.col("__id")) & (F.xxhash64("text") == F.col("__mark")), "left"
    )
    out = joined.withColumn("__rest", rest(F.col("text"), F.col("__spans")))
    return out.select(
        *[F.col("__rest.kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], "__rest.n_words", "__rest.n_removed"
    )


def query(spark, sf_dir):
    """``op10_substring_dedup``: what every text of ``documents`` keeps."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM words WHERE len(w) >= 20
), keyed AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS key FROM windows
), firsts AS (
  SELECT key, min({'d': doc_id, 's': s}) AS f FROM keyed GROUP BY key HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT k.doc_id, unnest(range(k.s, k.s + 20)) AS pos
  FROM keyed k JOIN firsts f ON k.key = f.key WHERE {'d': k.doc_id, 's': k.s} > f.f
), flat AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), kept AS (
  SELECT f.doc_id, count(g.pos) AS n_removed, string_agg(f.word, ' ' ORDER BY f.pos) FILTER (WHERE g.pos IS NULL) AS t
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos GROUP BY f.doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
