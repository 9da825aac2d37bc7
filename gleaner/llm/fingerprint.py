"""Document fingerprints from prefix polynomial hashes.

For a run of texts two modular prefix arrays are kept. Any span's hash follows from two of
their entries, so that spans are compared, and longest common extensions found by binary
search, without touching the text again. A fingerprint holds both hashes of the whole text
and the smallest distinct hashes of its spans of ``SPAN`` code points. Two texts are as like
as the spans that they have in common are long: from both ends, and from wherever their
fingerprints share a span, these are followed as far as they go on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import table

MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 12
KEPT = 64
#: Code points hashed at once; longer texts are hashed alone.
CHUNK = 1 << 18
#: Bytes of text in a bucket of neighbouring ids, and buckets at most.
BUCKET = 32 << 20
BUCKETS = 1 << 16
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to ``n`` of a base, or of its inverse, doubled from what is there."""
    p = MODULI[which]
    base = pow(BASES[which], p - 2, p) if inverse else BASES[which]
    out = _powers.get((which, inverse))
    if out is None:
        out = np.ones(1, dtype=np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    _powers[which, inverse] = out
    return out


class PrefixHashes:
    """Prefix hashes of some texts, laid end to end."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.prefix = []
        for which, p in enumerate(MODULI):
            terms = codes * powers(which, len(codes))[: len(codes)] % np.uint64(p)
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))

    def span(self, which: int, start, n) -> np.ndarray:
        """Hashes of the spans of ``n`` code points at the overall places ``start``."""
        p, h = np.uint64(MODULI[which]), self.prefix[which]
        inverse = powers(which, len(h), True)
        return (h[start + n] + p - h[start]) % p * inverse[start] % p

    def equal(self, a, b, n) -> np.ndarray:
        """Whether the spans of ``n`` code points at ``a`` and ``b`` (overall places) are equal."""
        out = np.ones(len(a), dtype=bool)
        for which, modulus in enumerate(MODULI):
            p, h, power = np.uint64(modulus), self.prefix[which], powers(which, len(self.prefix[which]))
            x, y = (h[a + n] + p - h[a]) % p, (h[b + n] + p - h[b]) % p
            out &= x * power[b] % p == y * power[a] % p
        return out

    def extension(self, a, b, most, back: bool = False) -> np.ndarray:
        """Longest common extensions from ``a`` and ``b`` on (or ``back`` from there), of at most ``most``, by binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), np.asarray(most, dtype=np.int64).copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo] + 1) // 2
            behind = mid if back else 0
            same = self.equal(a[todo] - behind, b[todo] - behind, mid)
            low[todo] = np.where(same, mid, low[todo])
            high[todo] = np.where(same, high[todo], mid - 1)
            todo = todo[low[todo] < high[todo]]
        return low


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that scatters them."""
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def sketches(hashes: PrefixHashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the ``KEPT`` smallest distinct hashes of its spans, in order, and an overall place of each."""
    total = int(hashes.starts[-1])
    every = _mixed(hashes.span(0, np.arange(max(0, total - SPAN + 1)), SPAN)) if total >= SPAN else np.zeros(0, np.uint32)
    out = []
    for start, n in zip(hashes.starts[:-1].tolist(), hashes.lengths.tolist(), strict=True):
        if n < SPAN:
            short = _mixed(hashes.span(0, np.array([start]), n)) if n else np.zeros(0, np.uint32)
            out.append((short, np.full(len(short), start)))
            continue
        own = every[start : start + n - SPAN + 1]
        at = np.argpartition(own, 4 * KEPT)[: 4 * KEPT] if len(own) > 8 * KEPT else np.arange(len(own))
        few, first = np.unique(own[at], return_index=True)
        if len(few) < KEPT and len(own) > 8 * KEPT:
            at = np.arange(len(own))
            few, first = np.unique(own, return_index=True)
        out.append((few[:KEPT], start + at[first[:KEPT]]))
    return out


def written_out(hashes: PrefixHashes, found: list[tuple[np.ndarray, np.ndarray]]) -> list[str]:
    """Fingerprints as text: both hashes of the whole, its length, and the sketch, in hex."""
    starts = hashes.starts[:-1]
    whole = [hashes.span(w, starts, hashes.lengths).tolist() for w in (0, 1)]
    return [f"{a:08x}{b:08x}{n:x}:{s.astype('>u4').tobytes().hex()}" for a, b, n, (s, _) in zip(*whole, hashes.lengths.tolist(), found, strict=True)]


def _covered(starts: np.ndarray, ends: np.ndarray) -> int:
    """Places that at least one of the intervals holds."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    before = np.concatenate([starts[:1], ends[:-1]])
    return int(np.maximum(0, ends - np.maximum(starts, before)).sum())


def likeness(hashes: PrefixHashes, found: list[tuple[np.ndarray, np.ndarray]], pairs: list[tuple[int, int]]) -> list[float]:
    """How alike the texts of each pair are: the share of both that lies in spans they have in common.

    Such spans start from both texts' beginnings, their ends, and each span that both
    sketches hold; they count from ``SPAN`` code points on, so that a shorter text is
    like none but its equals. Equal texts are 1, and no others.
    """
    starts, ends = hashes.starts[:-1], hashes.starts[1:]
    a, b, owner = [], [], []
    for x, (i, j) in enumerate(pairs):
        _, p, q = np.intersect1d(found[i][0], found[j][0], assume_unique=True, return_indices=True)
        a.append(np.concatenate([[starts[i], ends[i]], found[i][1][p]]))
        b.append(np.concatenate([[starts[j], ends[j]], found[j][1][q]]))
        owner.append(np.full(len(p) + 2, x))
    if not pairs:
        return []
    counts = np.array([len(x) for x in owner])
    a, b, owner = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64), np.concatenate(owner)
    first, second = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    ahead = hashes.extension(a, b, np.minimum(ends[first][owner] - a, ends[second][owner] - b))
    behind = hashes.extension(a, b, np.minimum(a - starts[first][owner], b - starts[second][owner]), back=True)
    n, m = hashes.lengths[first], hashes.lengths[second]
    counted = ahead + behind >= SPAN
    out = []
    edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
    for x, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        some = np.flatnonzero(counted[i:j]) + i
        total = int(n[x] + m[x])
        same = sum(_covered(y[some] - behind[some], y[some] + ahead[some]) for y in (a, b)) if len(some) else 0
        whole = n[x] == m[x] and (n[x] == 0 or ahead[i] == n[x])
        out.append(1.0 if whole else min(same, total - 1) / total)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    """Rows of the query for texts and the texts that follow them."""
    rows = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j])
            j += 1
        own, changed, after = texts[i:j], [edited(t, f) for t, f in zip(texts[i:j], following[i:j], strict=True)], following[i:j]
        # Most following texts are the next ones of the same run and are hashed only once.
        extra = [k for k in range(j - i) if k + 1 >= j - i or after[k] is not own[k + 1]]
        hashes = PrefixHashes(own + changed + [after[k] for k in extra])
        found = sketches(hashes)
        prints = written_out(hashes, found)
        n = j - i
        place = {k: 2 * n + x for x, k in enumerate(extra)}
        near = likeness(hashes, found, [(k, n + k) for k in range(n)] + [(k, place.get(k, k + 1)) for k in range(n)])
        for k in range(n):
            sha = hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((ids[i + k], len(own[k]), sha, prints[k], prints[n + k], near[k], near[n + k]))
        i = j
    return pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LEAST = -(1 << 63)


def chained(docs: DataFrame) -> DataFrame:
    """Rows dealt to buckets of neighbouring ids, sorted from the largest id down.

    Columns: ``bucket``, ``guest``, ``id``, ``void`` (the id is null), ``text``. The row that follows a
    bucket's last one is there too, as a guest: the largest of the bucket below, or for the
    lowest bucket the largest of all. A bucket has about ``BUCKET`` bytes of text, or more
    from ``BUCKETS`` of them on; the driver holds two ids for each. A bucket is sorted,
    on disk where need be, and read once.
    """
    source = docs.select(
        F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.col("doc_id").isNull().alias("void"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(BUCKETS, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET))
    ends = (
        source.select("id").repartitionByRange(buckets, "id").groupBy(F.spark_partition_id().alias("b"))
        .agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
    )
    ends = sorted((r.low, r.high) for r in ends)
    lows = np.array([x[0] for x in ends], dtype=np.int64)
    highs = {x[1]: b for b, x in enumerate(ends)}
    last = len(ends) - 1

    @F.pandas_udf("array<struct<bucket:int,guest:boolean>>")
    def dealt(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(lows, ids.to_numpy(), side="right") - 1
        out = []
        for i, b in zip(ids.tolist(), own.tolist(), strict=True):
            to = [(b, False)]
            if i in highs:
                to.append((b + 1, True) if b < last else (0, True))
            out.append(to)
        return pd.Series(out)

    spread = source.select("id", "void", "text", F.explode(dealt("id")).alias("d")).select("d.bucket", "d.guest", "id", "void", "text")
    return spread.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), "void", F.desc("text"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for each row of ``docs(doc_id, text)``.

    Documents follow each other by descending (``doc_id``, text), null ids last, and the
    last is followed by the first; a null text is empty. A text of under ``SPAN`` code
    points is one span; the empty text has none. Rows
    that repeat follow one another. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for pdf in batches:
            ids, texts, after = [], [], []
            for guest, doc_id, void, text in zip(*(pdf[c].tolist() for c in ("guest", "id", "void", "text")), strict=True):
                if waiting is not None:
                    ids.append(waiting[0])
                    texts.append(waiting[1])
                    after.append(text)
                # All but the first guest of a bucket are copies of it or come after it.
                waiting = None if guest else (None if void else doc_id, text)
            if texts:
                out = fingerprints(ids, texts, after)
                out["doc_id"] = pd.array(ids, dtype="Int64")
                yield out

    return chained(docs).mapInPandas(run, SCHEMA)


def query(spark, sf_dir):
    """``op6_fingerprint``: fingerprints of every text of ``documents`` and its edited text."""
    return document_fingerprints(table(spark, sf_dir, "documents"))
