"""N-gram Jaccard join of documents with a count-vector R-tree.

Distinct shingles are hashed into groups, and a set's counts by group are a point. A set's
signatures are its rarest shingles, so many of them that two sets that link share one. All
sets that share a signature with the same least set meet as points in an R-tree, where
summed coordinate minima bound the overlap from above, of a point with a box as of two
points; what the bound lets through ties sets to families, without loss. In a family the
pairs that the bound lets through are verified on the sets themselves. Only pairs of sets
that no link has joined yet are tried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table, written
from gleaner.llm.substring_dedup import _mixed, _spans, words_of
from gleaner.operators.graph import components
from gleaner.operators.tables import dropped

#: Groups of a point at least, and shingles for which a larger set has one more at least.
GROUPS = 128
DENSITY = 16
#: Points of a leaf or boxes of a node of the tree.
FAN = 32
#: Counters of the shingles' frequencies, by the lowest bits of their hashes.
RANKS = 1 << 16
#: Sets that meet at once as points.
MEET = 8192
#: Sets that a task verifies at once, and shingles of them; larger families are met in parts.
BLOCK = 256
SHINGLES = 1 << 20
#: Texts cut into shingles at once, in bytes.
CHUNK = 1 << 20
_LEAST = -(1 << 63)


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles as 64-bit hashes; none without words."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (at == first or size < CHUNK):
            words = (texts[at] or "").encode("utf-8", "surrogatepass").lower().split()
            if words:
                parts.append((at, len(words), b" ".join(words)))
                size += len(parts[-1][2])
            at += 1
        if not parts:
            continue
        hashes, _, _ = words_of(b" ".join([p[2] for p in parts]))
        every = _spans(hashes, np.arange(max(0, len(hashes) - k + 1)), np.arange(k, len(hashes) + 1)) if len(hashes) >= k else hashes[:0]
        word = 0
        for row, n, _ in parts:
            if n >= k:
                out[row] = np.unique(every[word : word + n - k + 1])
            else:
                out[row] = _mixed(_spans(hashes, np.array([word]), np.array([word + n])) + np.uint64(n))
            word += n
    return out


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    low, high = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return low, high


def places(own: np.ndarray) -> np.ndarray:
    """The frequency counters of shingles."""
    return (own % np.uint64(RANKS)).astype(np.int64)


def signatures(own: np.ndarray, rank: np.ndarray, per_cent: int) -> np.ndarray:
    """The shingles of a set that come first where those of rare counters do.

    ``rank`` orders the counters, so that it and a shingle's other bits order all shingles.
    Sets that link have at least ``per_cent`` of each of them in common, so of the first
    ones left when one fewer than that many are put aside, at least one is common.
    """
    first = len(own) - -(-len(own) * per_cent // 100) + 1
    keys = (rank[places(own)] << np.uint64(48)) | (own >> np.uint64(16))
    return np.partition(keys, first - 1)[:first] if first < len(keys) else keys


def points(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Counts of each set's shingles by group; larger sets have more groups, a power of two of them."""
    out = []
    for s in sets:
        groups = max(GROUPS, 1 << (max(0, len(s) - 1) // DENSITY).bit_length())
        out.append(np.bincount((_mixed(s) & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2"))
    return out


def _packed(point: np.ndarray) -> bytes:
    """A byte for each count where that will do, else two and a byte that makes their number odd."""
    return point.astype(np.uint8).tobytes() if point.max() < 256 else point.tobytes() + b"\0"


def _unpacked(row: bytes) -> np.ndarray:
    return np.frombuffer(row[:-1], "<u2") if len(row) % 2 else np.frombuffer(row, np.uint8).astype(np.uint16)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point of the same set with fewer groups."""
    return point if len(point) == groups else point.reshape(-1, groups).sum(0).astype(np.uint16)


class RTree:
    """Boxes over points of as many groups, packed bottom-up from an order by size and then by coordinates.

    Of a box only the largest corner matters to the bound, and its smallest and largest set.
    """

    def __init__(self, coordinates: np.ndarray, sizes: np.ndarray, per_cent: int):
        self.per_cent = per_cent
        self.order = np.lexsort((coordinates[:, 1], coordinates[:, 0], sizes)) if len(sizes) else np.zeros(0, np.int64)
        self.points, self.sizes = coordinates[self.order], sizes[self.order]
        self.levels = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > FAN:
            edges = np.arange(0, len(top), FAN)
            top, low, high = np.maximum.reduceat(top, edges), np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int, among: np.ndarray) -> np.ndarray:
        """Places of the points ``among`` all (a mask) whose bound lets them link to ``point``."""
        some = among[self.order]
        if some.sum() <= 2 * FAN:
            at = np.flatnonzero(some)
        else:
            at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
            for level in range(len(self.levels) - 1, -1, -1):
                top, low, high = self.levels[level]
                at = at[self._pass(top[at], low[at], high[at], point, size)]
                below = len(self.levels[level - 1][0]) if level else len(self.points)
                at = (at[:, None] * FAN + np.arange(FAN)).reshape(-1)
                at = at[at < below]
            at = at[some[at]]
        return self.order[at[self._pass(self.points[at], self.sizes[at], self.sizes[at], point, size)]]

    def _pass(self, corner, low, high, point, size):
        fits = (100 * high >= self.per_cent * size) & (100 * size >= self.per_cent * low)
        out = np.zeros(len(corner), bool)
        some = np.flatnonzero(fits)
        overlap = np.minimum(corner[some], point).sum(1, dtype=np.int64)
        out[some] = (100 + self.per_cent) * overlap >= self.per_cent * (size + low[some])
        return out


class Points:
    """Points of any numbers of groups: a tree for each, and for fewer groups where a smaller set asks."""

    def __init__(self, coordinates: list[np.ndarray], sizes: np.ndarray, per_cent: int):
        self.coordinates, self.sizes, self.per_cent = coordinates, sizes, per_cent
        groups = np.array([len(x) for x in coordinates])
        self.own = {int(g): np.flatnonzero(groups == g) for g in np.unique(groups)}
        self.trees: dict[tuple[int, int], RTree] = {}

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Places of the points ``among`` all (a mask) whose bound lets them link to point ``i``."""
        out = []
        size, point = int(self.sizes[i]), self.coordinates[i]
        for groups, own in self.own.items():
            sizes = self.sizes[own]
            if not among[own].any() or 100 * sizes.max() < self.per_cent * size or 100 * size < self.per_cent * sizes.min():
                continue
            fewer = min(groups, len(point))
            if (groups, fewer) not in self.trees:
                self.trees[groups, fewer] = RTree(np.stack([folded(self.coordinates[x], fewer) for x in own.tolist()]), sizes, self.per_cent)
            out.append(own[self.trees[groups, fewer].near(folded(point, fewer), size, among[own])])
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray], labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what all links of ``n`` things join.

    ``near(i, among)`` finds those ``among`` the things (a mask) that link to thing ``i``.
    Things of the same label are joined to begin with.
    """
    own: dict[int, list[int]] = {}
    for i, label in enumerate(labels.tolist() if labels is not None else ()):
        own.setdefault(label, []).append(i)
    left, out = np.ones(n, bool), []

    def taken(i: int) -> list[int]:
        new = own[int(labels[i])] if labels is not None else [i]
        left[new] = False
        return new

    for first in range(n):
        queue = taken(first) if left[first] else []
        while queue and left.any():
            i = queue.pop()
            for x in near(i, left).tolist():
                if left[x]:
                    out.append((i, x))
                    queue += taken(x)
    return out


def near_sets(sets: list[np.ndarray], per_cent: int, side: np.ndarray | None = None):
    """For ``forest``: sets that link, found in the tree and verified; of the other ``side`` only where sides are given."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bounded = Points(points(sets), sizes, per_cent)
    values, dense = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    member = np.zeros(len(values), bool)

    def near(i: int, among: np.ndarray) -> np.ndarray:
        found = bounded.near(i, among if side is None else among & (side != side[i]))
        if not len(found):
            return found
        own = dense[starts[i] : starts[i + 1]]
        member[own] = True
        both = np.array([np.count_nonzero(member[dense[starts[x] : starts[x + 1]]]) for x in found.tolist()])
        member[own] = False
        return found[100 * both >= per_cent * (sizes[i] + sizes[found] - both)]

    return near


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """``(handle, id, n, c1, c2, point)`` of each document's set, and ``(place, times)`` of frequency counters.

    A task adds up the shingles of its documents in ``RANKS`` counters, which are rows of
    their own after its documents.
    """
    schema = "handle long, id long, n long, c1 long, c2 long, point binary, place int, times long"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())

    def rows(size, **columns):
        names = [c.split()[0] for c in schema.split(", ")]
        made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(made, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(RANKS, np.int64)
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), k)
            c1, c2 = zip(*map(digest, sets)) if sets else ((), ())
            if sets:
                times += np.bincount(places(np.concatenate(sets)), minlength=RANKS)
            yield rows(len(sets), handle=batch.column(0), id=batch.column(1), n=[len(s) for s in sets], c1=c1, c2=c2, point=[_packed(x) for x in points(sets)])
        some = np.flatnonzero(times)
        yield rows(len(some), place=some.astype(np.int32), times=times[some])

    return docs.select("handle", "id", "text").mapInArrow(run, schema)


def _ranks(profiles: DataFrame) -> np.ndarray:
    """The order of the frequency counters, rare ones first: at most ``RANKS`` rows come to the driver."""
    times = np.zeros(RANKS, np.int64)
    for place, n in profiles.where("place IS NOT NULL").groupBy("place").agg(F.sum("times")).collect():
        times[place] = n
    rank = np.empty(RANKS, np.uint64)
    rank[np.argsort(times, kind="stable")] = np.arange(RANKS, dtype=np.uint64)
    return rank


def _keys(docs: DataFrame, k: int, per_cent: int, rank: np.ndarray) -> DataFrame:
    """``(key, c)``: the signatures of each set, by the first half of its digest; once for the copies in a batch."""
    short = rank.astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = short.astype(np.uint64)
        for batch in batches:
            seen: set[int] = set()
            keys, owners = [], []
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                if len(s) and (c := digest(s)[0]) not in seen:
                    seen.add(c)
                    keys.append(signatures(s, order, per_cent))
                    owners.append(np.full(len(keys[-1]), c, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "c"])

    return docs.select("text").mapInArrow(run, "key long, c long")


def _meetings(keys: DataFrame) -> DataFrame:
    """``(home, c)``: sets that share a signature with a lesser one, each with the least set that has it."""
    least = F.first("c").over(Window.partitionBy("key").orderBy("c"))
    return keys.withColumn("home", least).where(F.col("c") != F.col("home")).select("home", "c").distinct()


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _candidates(meetings: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Edges ``(a, b)`` that tie the sets of a meeting which the bound lets link, directly or over others.

    Where more than ``MEET`` sets meet, they do so in parts that each have the least set of
    all, and the trees of a part are tied to that by an edge as well.
    """

    def edges(home, c, sizes, rows, cut):
        _, first = np.unique(c, return_index=True)
        c, sizes = c[first], sizes[first]
        found = forest(len(c), Points([_unpacked(rows[i]) for i in first], sizes, per_cent).near)
        out = [(int(c[i]), int(c[x])) for i, x in found]
        return out + [(home, int(c[i])) for i in np.setdiff1d(np.arange(len(c)), [x for _, x in found]).tolist()] if cut else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_none(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held is None or not held.num_rows:
                continue
            home, part, cut, c, n = (held.column(i).to_numpy() for i in range(5))
            starts = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (part[1:] != part[:-1])]))
            keep = held.num_rows if batch is None else int(starts[-1])
            ends = np.append(starts[1:], held.num_rows)
            rows = held.column(5).slice(0, keep).to_pylist()
            found = []
            done = ends <= keep
            two = done & (ends - starts == 2)
            by_groups: dict[tuple[int, int], list[int]] = {}
            for s in starts[two].tolist():
                by_groups.setdefault((len(rows[s]), len(rows[s + 1])), []).append(s)
            for some in by_groups.values():
                at = np.array(some)
                a, b = (np.stack([_unpacked(rows[i]) for i in (at + j).tolist()]) for j in (0, 1))
                fewer = min(a.shape[1], b.shape[1])
                a, b = (z.reshape(len(at), -1, fewer).sum(1) for z in (a, b))
                fits = cut[at] | ((100 + per_cent) * np.minimum(a, b).sum(1, dtype=np.int64) >= per_cent * (n[at] + n[at + 1]))
                found += list(zip(c[at[fits]].tolist(), c[at[fits] + 1].tolist()))
            for s, e in zip(starts[done & (ends - starts > 2)].tolist(), ends[done & (ends - starts > 2)].tolist()):
                found += edges(int(home[s]), c[s:e], n[s:e], rows[s:e], bool(cut[s]))
            held = held.slice(keep)
            some = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["a", "b"])

    large = meetings.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts")).where("parts > 1")
    joined = meetings.join(large, "home", "left").withColumn("cut", F.col("parts").isNotNull())
    dealt = joined.select("home", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "cut", "c")
    every = dealt.unionByName(dealt.select("home", "part", "cut").distinct().withColumn("c", F.col("home")))
    placed = every.join(classes.select(F.col("c1").alias("c"), "n", "point"), "c").select("home", "part", "cut", "c", "n", "point")
    return placed.repartition("home", "part").sortWithinPartitions("home", "part", "c", "n").mapInArrow(run, "a long, b long").distinct()


def _verified(groups: DataFrame, by: list[str], k: int, per_cent: int) -> DataFrame:
    """Links ``(a, b)`` between nodes that join what all links inside each group join.

    ``groups`` has ``node, c1, text`` and may have ``side`` (only pairs across are tried)
    and ``label`` (nodes of one label are joined already). A row whose text does not have
    the digest ``c1`` shares only its handle with the class and is left out.
    """

    def join(group: pa.Table) -> pa.Table:
        def values(name):
            return np.array(group.column(name).to_pylist(), dtype=np.int64)

        node, c1 = values("node"), values("c1")
        sets = shingle_sets(group.column("text").to_pylist(), k)
        own = np.array([i for i, s in enumerate(sets) if len(s) and digest(s)[0] == c1[i]], dtype=np.int64)
        side = values("side")[own] if "side" in group.column_names else None
        what = np.stack([node[own], side if side is not None else node[own]], axis=1)
        _, first = np.unique(what, axis=0, return_index=True)
        own, side = own[np.sort(first)], side[np.sort(first)] if side is not None else None
        found = []
        if len(own) > 1:
            labels = values("label")[own] if "label" in group.column_names else node[own]
            found = forest(len(own), near_sets([sets[i] for i in own], per_cent, side), labels)
        pairs = node[own][np.array(found, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return groups.groupBy(*by).applyInArrow(join, "a long, b long")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the ``label`` of what links have joined so far: a node."""
    found = components(links).select("node", F.col("component").alias("label"))
    return members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _parts(members: DataFrame, by: list[str], name: str) -> DataFrame:
    """``members`` with ``name``: a number of the part they are dealt to; no part is much above the limits of a task."""
    sizes = members.groupBy(*by).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(SHINGLES))).cast("int").alias("__parts")
    )
    return members.join(sizes, by).withColumn(name, F.pmod(F.xxhash64("node"), F.col("__parts")).cast("int")).drop("__parts")


def _stars(texts: DataFrame, large: DataFrame, edges: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links between the sets of large families and, for each, the set of most candidate edges that one ties it to."""
    own = edges.join(large.select(F.col("c1").alias("b")), "b", "left_semi")
    degrees = own.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    hub = own.join(degrees, "a").groupBy("b").agg(F.max(F.struct("degree", "a"))["a"].alias("hub"))
    leaves = _parts(large.join(hub.withColumnRenamed("b", "c1"), "c1").select("node", "c1", "n", "hub"), ["hub"], "part")
    leaves = leaves.select("hub", "part", "node", "c1", F.lit(1).alias("side"))
    hubs = leaves.select("hub", "part").distinct().join(large.select(F.col("c1").alias("hub"), "node"), "hub")
    both = leaves.unionByName(hubs.select("hub", "part", "node", F.col("hub").alias("c1"), F.lit(0).alias("side")))
    return _verified(_with_text(texts, both), ["hub", "part"], k, per_cent)


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with their ``text``; of rows that repeat a handle and its text one is enough."""
    found = docs.select("handle", "text").join(members.hint("shuffle_hash"), "handle")
    return found.dropDuplicates(["handle", "c1"])


def _with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    return texts.select("node", "text").join(rows.hint("shuffle_hash"), "node")


def _rest(texts: DataFrame, large: DataFrame, links: DataFrame, k: int, per_cent: int) -> DataFrame | None:
    """Links that join the sets of large families which ``links`` have left apart; none where they have left none.

    Sets outside the largest joined part of a family meet all sets of the family: first as
    points, in blocks of like sizes, where only blocks whose sizes can link meet; then the
    texts of those that the bound lets through.
    """
    labelled = written(_labelled(large, links), "labelled")
    counts = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("times"))
    main = counts.groupBy("family").agg(F.max(F.struct("times", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
    open_ = labelled.join(main.where("labels > 1").select("family", F.col("most.label").alias("main")), "family")
    if open_.isEmpty():
        return None
    # Bands of sizes: two sets that link lie in the same band or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / per_cent) + 1e-9))).cast("int")
    dealt = written(_parts(open_.withColumn("band", band), ["family", "band"], "part"), "dealt")
    columns = ("node", "c1", "n", "label", "point")
    blocks = dealt.groupBy("family", "band", "part").agg(F.max((F.col("label") != F.col("main")).cast("int")).alias("asks"))
    left = blocks.where("asks = 1").select("family", F.col("band").alias("band0"), F.col("part").alias("part0"))
    pairs = left.withColumn("band", F.explode(F.sequence(F.col("band0") - 1, F.col("band0") + 1))).join(blocks.drop("asks"), ["family", "band"])
    by = ["family", "band0", "part0", "band", "part"]
    asks = dealt.where(F.col("label") != F.col("main")).select("family", F.col("band").alias("band0"), F.col("part").alias("part0"), *columns)
    meet = pairs.join(asks, ["family", "band0", "part0"]).select(*by, *columns, F.lit(0).alias("side")).unionByName(
        pairs.join(dealt, ["family", "band", "part"]).select(*by, *columns, F.lit(1).alias("side"))
    )

    def bounded(group: pa.Table) -> pa.Table:
        n, label, side = (group.column(c).to_numpy() for c in ("n", "label", "side"))
        tree = Points([_unpacked(x) for x in group.column("point").to_pylist()], n, per_cent)
        needed = np.zeros(len(n), bool)
        for i in np.flatnonzero(side == 0).tolist():
            found = tree.near(i, (side == 1) & (label != label[i]))
            needed[found] = True
            needed[i] = len(found) > 0
        return group.select([*by, "node", "c1", "label", "side"]).filter(pa.array(needed))

    schema = "family long, band0 int, part0 int, band int, part int, node long, c1 long, label long, side int"
    through = meet.groupBy(*by).applyInArrow(bounded, schema)
    return _verified(_with_text(texts, through), by, k, per_cent)


def _joined(docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """``(handle, id, n, root, component)`` for each row of ``docs(handle, id, text)``.

    ``root`` names a component, and ``component`` is its smallest id, a null one first; both
    are null without words.
    """
    profiles = written(_profiles(docs, k), "profiles")
    sets = profiles.where("place IS NULL")
    least = F.min(F.coalesce("id", F.lit(_LEAST)))
    grouped = sets.where("n > 0").groupBy("c1", "c2").agg(
        F.min("id").alias("first"), least.alias("least"), F.min("handle").alias("handle"), F.first("n").alias("n"), F.first("point").alias("point")
    )
    classes = written(grouped.withColumn("node", F.coalesce("first", "c1")).drop("first"), "classes")
    meetings = written(_meetings(_keys(docs, k, per_cent, _ranks(profiles))), "meetings")
    edges = written(_candidates(meetings, classes, per_cent), "candidates")
    dropped(meetings)
    families = components(edges).select(F.col("node").alias("c1"), F.col("component").alias("family"))
    own = classes.join(families, "c1").select("node", "c1", "handle", "n", "point", "family")
    sizes = own.groupBy("family").agg(((F.count(F.lit(1)) > BLOCK) | (F.sum("n") > SHINGLES)).alias("large"))
    members = written(own.join(sizes, "family"), "members")
    large = members.where("large").drop("large")
    texts = written(_texts(docs, members.select("node", "c1", "handle", "family", "large")), "texts")
    spent = [edges, members, texts, written(_verified(texts.where("NOT large"), ["family"], k, per_cent), "links")]
    every = spent[-1]
    if not large.isEmpty():
        spent.append(written(_stars(texts, large, edges, k, per_cent), "links"))
        every = every.unionByName(spent[-1])
        rest = _rest(texts, large, spent[-1], k, per_cent)
        every = every.unionByName(rest) if rest is not None else every
    found = components(every).select("node", F.col("component").alias("root"))
    for df in spent:
        dropped(df)
    rooted = classes.join(found, "node", "left").select("c1", "c2", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("c1", "c2", "root", "component")
    return sets.select("handle", "id", "n", "c1", "c2").join(named, ["c1", "c2"], "left").select("handle", "id", "n", "root", "component")


def _source(docs: DataFrame) -> DataFrame:
    """``(handle, id, text)``; rows that repeat id and text have the same handle, also where the id is null."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("handle"), F.col("doc_id").cast("long").alias("id"), "text")


def jaccard_components(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """``(id, n, component)`` for each row of ``docs(doc_id, text)``.

    ``n`` is the number of distinct ``k``-word shingles of the whole text, A-Z lowered; a
    text of fewer words is one shingle, and one without words, or null, has none and links
    with nothing. Documents link when their sets' intersection is at least ``per_cent`` of
    their union; ``component`` is the smallest id that links reach. Equal sets are one
    class. A null id counts as the smallest, and rows of null id are each judged by their
    own text. Rows that repeat an id are expected to repeat its text. An empty table has no
    rows; columns besides ``doc_id`` and ``text`` are not read.
    """
    found = _joined(_source(docs), k, per_cent)
    id_ = F.coalesce("id", F.lit(_LEAST))
    return found.select(id_.alias("id"), "n", F.when(F.col("n") > 0, F.col("component")).otherwise(id_).alias("component"))


def representatives(docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does: the one of the smallest id.

    Rows without words stay. Null ids come after all others, and rows of one component
    without any id keep one of them; of rows that repeat an id and its text one stays.
    """
    keyed = docs.select(F.struct("*").alias("__row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("__handle"))
    words = F.coalesce(F.col("__row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = _joined(_source(docs), k, per_cent).where("n > 0")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "handle"))["handle"].alias("__handle"))
    kept = keyed.where(words).join(first.select("__handle"), "__handle", "left_semi").dropDuplicates(["__handle"])
    return kept.unionByName(keyed.where(~words)).select("__row.*")


def query(spark, sf_dir):
    """``op9_jaccard_join``: components of ``documents`` at nine tenths of their 3-word shingles."""
    found = jaccard_components(table(spark, sf_dir, "documents"), 3, 90)
    null = lambda c: F.when(F.col(c) != _LEAST, F.col(c)).alias(c)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).select(
        null("doc_id"), "n_shingles", null("component_id")
    )


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs p JOIN sizes a ON p.x = a.doc_id JOIN sizes b ON p.y = b.doc_id
  WHERE 100 * shared >= 90 * (a.n + b.n - shared)
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach r ON d.doc_id = r.doc_id
GROUP BY ALL
"""
