"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are dealt to partitions, and each partition is packed best-fit decreasing. A
lower bound from dual feasible functions certifies a partition whose number of sequences it
equals: that partition is closed, but for sequences at most half full, two of which may
make one. The others have a gap to their bound; while the whole is above its own bound,
their sequences that are not full give up their documents, which are dealt anew with those
of other partitions and packed again.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import table, written

CAPACITY = 2048
END = b"\0\0\0\0"
#: Words kept with their ids by each Python worker, about 150 MB.
CACHED = 600_000

#: How this kind of vocabulary cuts texts into pre-tokens ...
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ... and what a text may not hold to be cut by ``tiktoken``: characters beyond those that any version of Unicode has
#: alike, and long runs of blanks.
_RARE = re.compile(r"[^\x20-\x7E\n\u00A1-\u00AC\u00AE-\u024F\u2010-\u2027]")
_LONG = re.compile(r"\s{9}")
_OTHER = re.compile(r"[^\S\x20\n]")
_BLANK = re.compile(r"(?<=\S)\x20(?=\S)")
#: Latin letters, then signs that are neither letters, digits, blanks nor apostrophes.
_LATIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([^\w\s']*)")


def byte_ranks(path: str) -> dict[bytes, int]:
    """The ids of a byte-level vocabulary by the bytes they stand for."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown}
    byte |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def special_ids(path: str) -> dict[str, int]:
    """The ids of a vocabulary's special tokens; only tokens that take no blanks with them are known here."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    odd = [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that are not taken as they are: {odd}")
    return {t["content"]: t["id"] for t in added}


def common(text: str) -> bool:
    """Whether ``tiktoken`` may cut the text. A long run of blanks holds one of the four that are looked for first."""
    if _RARE.search(text):
        return False
    return not ("    " in text or "\n\n\n\n" in text or " \n" in text or "\n " in text) or not _LONG.search(text)


class _Known(dict):
    """Ids of words as bytes, worked out when first asked for; forgotten when there are too many."""

    def __init__(self, owner: Ids, blank: str):
        self.owner, self.blank = owner, blank

    def __missing__(self, word: str) -> bytes:
        out = self.owner.word(word, self.blank)
        if len(self) >= CACHED:
            self.clear()
        self[word] = out
        return out


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    A text of common characters is encoded at once, by ``tiktoken`` with the vocabulary's
    ranks. In others the vocabulary's pre-tokenisation always ends a token before a single
    blank between two characters that are no blanks, so a text may be cut there and its
    words looked up. A new word of Latin letters with signs behind it is one or two pre-tokens and is merged
    at once; any other is left to ``tokenizers``. The names of special tokens in a text are
    these tokens, as ``tokenizers`` has it, and what lies between them is a text of its own.
    """

    def __init__(self, path: str):
        self.path, self.tool, self.merge, self.whole = path, None, None, None
        self.special = special_ids(path)
        self.names = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.first, self.later = _Known(self, ""), _Known(self, " ")

    def __reduce__(self):
        return Ids, (self.path,)

    def load(self) -> None:
        if self.tool is None:
            import tiktoken
            from tokenizers import Tokenizer

            self.tool = Tokenizer.from_file(self.path)
            core = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=byte_ranks(self.path), special_tokens={})._core_bpe
            self.merge, self.whole = core.encode_single_piece, core.encode_to_tiktoken_buffer

    def word(self, word: str, blank: str) -> bytes:
        if m := _LATIN.fullmatch(word):
            ids = self.merge((blank + m[1]).encode())
            if m[2]:
                ids += self.merge(m[2].encode())
        elif "\n" in word and all(parts := word.split("\n")) and not _OTHER.search(word) and " " not in word:
            # A line end between two characters that are no blanks is a token by itself.
            return self.word("\n", "").join([self.later[parts[0]] if blank else self.first[parts[0]], *(self.first[x] for x in parts[1:])])
        else:
            ids = self.tool.encode(blank + word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.names and self.names.search(text):
            ends = [0]
            for m in self.names.finditer(text):
                ends += m.span()
            ends.append(len(text))
            parts = [text[a:b] for a, b in zip(ends, ends[1:])]
            return b"".join(struct.pack("<I", self.special[x]) if i % 2 else self.plain(x) for i, x in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without names of special tokens."""
        if not text:
            return b""
        self.load()
        if common(text):
            return bytes(self.whole(text, set()))
        odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER.search(text)
        cut = _BLANK.split(text) if odd else text.split(" ")
        return self.first[cut[0]] + b"".join(map(self.later.__getitem__, cut[1:]))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, id 0 at its end.

    A document of more than ``capacity`` tokens is cut into pieces of that length, the
    first of which may be shorter. A null text is empty: one piece, one token.
    """
    ids = Ids(path)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = ids.encode(text or "") + END
                n = len(data) // 4
                end = n % capacity or capacity
                start = piece = 0
                while start < n:
                    rows.append((row, piece, start, end - start, zlib.crc32(data[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: the fullest bin it fits in, longest items first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    spare: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0  # bit r: some bin has r left
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = spare[r].pop()
            if not spare[r]:
                mask ^= 1 << r
        else:
            b, r, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - r
        r -= size
        if r:
            spare[r].append(b)
            mask |= 1 << r
    return bins, offsets


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that items (``counts`` of each of the distinct ``lengths``) need at least.

    The largest over two families of dual feasible functions: for each threshold, items
    over half that can't meet one above it count whole and those below it not at all; and
    for each k, sizes rounded down to multiples of 1/k unless they are one of 1/(k + 1).
    """
    if not len(lengths):
        return 0
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for t in np.unique(np.concatenate([[0], x[x <= capacity // 2]])).tolist():
        huge, large, small = x > capacity - t, (x <= capacity - t) & (2 * x > capacity), (x >= t) & (2 * x <= capacity)
        room = int(n[large].sum()) * capacity - int((x * n)[large].sum())
        best = max(best, int(n[huge | large].sum()) + max(0, -(-(int((x * n)[small].sum()) - room) // capacity)))
    for k in range(1, 65):
        y = (k + 1) * x
        exact = y % capacity == 0
        whole, rounded = int((x * n)[exact].sum()), int((y // capacity * n)[~exact].sum())
        best = max(best, -(-(whole * k + rounded * capacity) // (capacity * k)))
    return best


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long, bins long, bound long"


def _packed(items: DataFrame, parts: int, first_part: int, salt: int, capacity: int) -> DataFrame:
    """Items dealt to ``parts`` partitions by hash, each packed in a task of its own."""

    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        for name, values in (("bin", bins), ("offset", offsets), ("fill", fill[bins])):
            group = group.append_column(name, pa.array(values, pa.int64()))
        for name, value in (("bins", n), ("bound", bound)):
            group = group.append_column(name, pa.array(np.full(len(bins), value), pa.int64()))
        return group

    part = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "ids_crc32"), F.lit(parts)) + first_part
    dealt = items.select("doc_id", "piece", "start", "length", "ids_crc32", part.alias("part"))
    return dealt.groupBy("part").applyInArrow(pack, SCHEMA)


def _used(df) -> int:
    """Sequences of a table of packed items."""
    return df.groupBy("part").agg(F.max("bins").alias("bins")).agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]


def pack(items: DataFrame, capacity: int = CAPACITY, target: int = 2048, rounds: int | None = None) -> DataFrame:
    """``items(doc_id, piece, start, length, ids_crc32)`` with ``sequence_id`` and ``offset``.

    Each partition holds about ``target`` items, so a task's memory doesn't grow with the
    input. ``bound`` of a row is its partition's own. After the first packing there are up to
    ``rounds`` exchanges (by default until one saves nothing), and only while there are more
    sequences than the bound of the whole: the items of sequences with room that lie in
    partitions above their own bound, or that are at most half full, are dealt and packed
    anew; an exchange that saves nothing is not taken over. The driver holds one count for
    each length. An empty table gives an empty result; rows that repeat are packed each.
    """
    items = written(items, "pieces")
    n = items.count()
    histogram = sorted((r.length, r["count"]) for r in items.groupBy("length").count().collect())
    lengths, counts = (np.array(x, dtype=np.int64) for x in zip(*histogram, strict=True)) if histogram else (np.zeros(0), np.zeros(0))
    least = lower_bound(lengths, counts, capacity)
    parts = max(1, math.ceil(n / target))
    out = written(_packed(items, parts, 0, 0, capacity), "packed")
    used, next_part, k = _used(out), parts, 0
    open_ = (F.col("fill") < capacity) & ((F.col("bins") > F.col("bound")) | (2 * F.col("fill") <= capacity))
    while used > least and (rounds is None or k < rounds):
        k += 1
        held, bins = out.where(open_).agg(F.count(F.lit(1)), F.count_distinct("part", "bin")).first()
        parts = max(1, math.ceil(held / target))
        again = written(_packed(out.where(open_), parts, next_part, k, capacity), "repacked")
        new = _used(again)
        next_part += parts
        if new >= bins:
            break
        used += new - bins
        out = out.where(~open_).unionByName(again)
    return out.withColumn("sequence_id", F.shiftleft("part", 20) + F.col("bin"))


def query(spark, sf_dir):
    """``op5_packing``: all ``documents`` in sequences of at most 2048 tokens."""
    from public_tokenizers import path

    out = pack(pieces(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
