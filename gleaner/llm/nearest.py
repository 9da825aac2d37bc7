"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by fast Hadamard pseudo-rotations and files each under the
nearest signed axis, or under one of each of several rotations, the last of which may know
only some of the axes: so there are about as many buckets as the rows ask for. A query
probes the buckets nearest to it in every table; what it meets there is ranked by exact
inner products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gleaner.llm.common import table, written

TABLES = 8
ROTATIONS = 3
#: Rows of one side that a task compares at once.
BLOCK = 8192
#: Queries that the probes are fitted on, and as many others that the recall is measured on.
SAMPLE = 64
RECALL = 0.96
#: Buckets of a table at most, as a power of two.
MOST = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` times the Hadamard matrix, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class CrossPolytope:
    """``tables`` hash tables of two to the power of ``bits`` buckets for vectors of ``dim`` components.

    There are at least the buckets of one whole rotation. ``longest`` is the largest length
    of any row, or None where all have the same: then inner products rank as angles do.
    Otherwise rows get one more component that brings them all to that length, and queries
    a zero.
    """

    def __init__(self, dim: int, bits: int = 0, longest: float | None = None, tables: int = TABLES):
        self.dim, self.longest, self.tables = dim, longest, tables
        self.width = 1 << max(1, (dim + (longest is not None) - 1).bit_length())
        whole = self.width.bit_length()
        full, rest = divmod(max(bits, whole), whole)
        #: Signed axes of each rotation.
        self.axes = [2 * self.width] * full + ([1 << rest] if rest else [])
        rng = np.random.default_rng(20240229)
        self.signs = rng.choice(np.array([-1.0, 1.0]), size=(tables, len(self.axes), ROTATIONS, self.width))

    @property
    def buckets(self) -> int:
        return math.prod(self.axes)

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        length = np.sqrt((x * x).sum(1, keepdims=True))
        if query or self.longest is None:
            out[:, : self.dim] = x / length
        else:
            out[:, : self.dim] = x / self.longest
            out[:, self.dim] = np.sqrt(np.maximum(0.0, 1 - (length[:, 0] / self.longest) ** 2))
        return out

    def turned(self, u: np.ndarray, t: int, part: int) -> np.ndarray:
        """Scores of the signed axes: the positive ones, then the negative ones."""
        for signs in self.signs[t, part]:
            u = hadamard(u * signs)
        u = u[:, : self.axes[part] // 2]
        return np.concatenate([u, -u], axis=1)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        u = self.unit(x, False)
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for part, axes in enumerate(self.axes):
                out[:, t] = out[:, t] * axes + self.turned(u, t, part).argmax(1)
        return out

    def scores(self, x: np.ndarray, t: int) -> np.ndarray:
        """The sum of axis scores of every bucket of a table, for each query."""
        u = self.unit(x, True)
        out = self.turned(u, t, 0)
        for part in range(1, len(self.axes)):
            out = (out[:, :, None] + self.turned(u, t, part)[:, None, :]).reshape(len(x), -1)
        return out

    def probe(self, x: np.ndarray, t: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest buckets of a table for each query."""
        if probes >= self.buckets:
            return np.tile(np.arange(self.buckets), (len(x), 1))
        step = max(1, (1 << 24) // self.buckets)
        return np.concatenate([np.argpartition(-self.scores(x[i : i + step], t), probes - 1, axis=1)[:, :probes] for i in range(0, len(x), step)])

    def ranks(self, queries: np.ndarray, found: np.ndarray) -> np.ndarray:
        """For pairs of a query and a row, the place of the row's bucket among the query's, best of all tables."""
        filed = self.file(found)
        best = np.full(len(queries), self.buckets)
        for t in range(self.tables):
            step = max(1, (1 << 23) // self.buckets)
            for i in range(0, len(queries), step):
                s = self.scores(queries[i : i + step], t)
                own = np.take_along_axis(s, filed[i : i + step, t : t + 1], 1)
                best[i : i + step] = np.minimum(best[i : i + step], (s >= own).sum(1))
        return best


def vectors_of(column: pa.Array) -> np.ndarray:
    """A batch of lists of equal length as rows of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int):
    """(query row, id, score) of the ``k`` largest inner products of each query, ties to smaller ids.

    Scores are summed row by row at the end, so that equal vectors score alike in any block.
    """
    rows, found, scores = [], [], []
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        s = q @ vectors.T
        s[own[i : i + 256, None] == ids[None, :]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0)))
        r, c = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        exact = np.empty(len(r))
        for j in range(0, len(r), 1 << 16):
            exact[j : j + (1 << 16)] = (q[r[j : j + (1 << 16)]] * vectors[c[j : j + (1 << 16)]]).sum(1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, np.arange(len(q)))
        keep = np.arange(len(r)) - first[r] < k
        rows.append(r[keep] + i)
        found.append(ids[c[keep]])
        scores.append(exact[keep])
    return (np.concatenate(x) if x else np.zeros(0) for x in (rows, found, scores))


PAIR = "query_id long, vec_id long, score double"


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct pairs of each query with their rank."""
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _exact(rows: DataFrame, sample: list, k: int) -> DataFrame:
    """True neighbours of a few queries, with their vectors: one pass over all rows."""
    own, queries = np.array([r.vec_id for r in sample], dtype=np.int64), np.array([r.embedding for r in sample], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), vectors_of(batch.column(1))
                r, v, s = nearest(queries, ids, x, own, k)
                at = {i: n for n, i in enumerate(ids.tolist())}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[r.astype(int)]), pa.array(v.astype(np.int64)), pa.array(s.astype(float)), batch.column(1).take(pa.array([at[i] for i in v.tolist()], pa.int64()))],
                    names=["query_id", "vec_id", "score", "embedding"],
                )

    found = rows.mapInArrow(run, f"{PAIR}, embedding {rows.schema['embedding'].dataType.simpleString()}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _filed(rows: DataFrame, queries: DataFrame, index: CrossPolytope, probes: int, tables: int) -> tuple[DataFrame, DataFrame]:
    """Rows under their buckets, and queries under those that they probe."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = index.file(vectors_of(batch.column(1)))[:, :tables] if batch.num_rows else np.zeros((0, tables), np.int64)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), t, np.int32)), pa.array(buckets[:, t]), *batch.columns], names=["t", "bucket", "vec_id", "embedding"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column(1))
            for t in range(tables if batch.num_rows else 0):
                buckets = index.probe(x, t, probes)
                m = buckets.shape[1]
                at = pa.array(np.repeat(np.arange(batch.num_rows), m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int32)), pa.array(buckets.reshape(-1)), *(c.take(at) for c in batch.columns)], names=["t", "bucket", "vec_id", "embedding"]
                )

    schema = f"t int, bucket long, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}"
    return rows.mapInArrow(filed, schema), queries.mapInArrow(probed, schema)


def _search(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Every query of ``right(t, bucket, vec_id, embedding)`` against the rows of its buckets in ``left``, block by block."""
    # Blocks: a bucket with many rows, or many queries, is cut on that side and met by every
    # block of the other. The counts have a row for each bucket in use; they stay in tables.
    cuts = lambda df, name: df.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = written(cuts(left, "a").join(cuts(right, "b"), ["t", "bucket"]), "buckets")
    # Of the many buckets only those cut on a side are looked up, and at most (rows times
    # tables / BLOCK) of them exist; the join leaves it to Spark, by size, to send them or not.
    cut = sizes.where((F.col("a") > 1) | (F.col("b") > 1))

    def block(df, own, other):
        df = df.join(cut, ["t", "bucket"], "left")
        mine = F.pmod(F.xxhash64("vec_id"), F.coalesce(own, F.lit(1))).cast("int")
        return df.select("t", "bucket", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias("other"), "vec_id", "embedding")

    left = block(left, F.col("a"), "b").withColumnsRenamed({"own": "i", "other": "j"})
    right = block(right, F.col("b"), "a").withColumnsRenamed({"own": "j", "other": "i"})

    def meet(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = data.column("vec_id").to_numpy(), vectors_of(data.column("embedding").combine_chunks())
        own, q = asked.column("vec_id").to_numpy(), vectors_of(asked.column("embedding").combine_chunks())
        r, v, s = nearest(q, ids, x, own, k)
        return pa.table({"query_id": pa.array(own[r.astype(int)], pa.int64()), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(s.astype(float))})

    key = ["t", "bucket", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, PAIR)


def nearest_neighbours(vectors: DataFrame, asked, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score, recall)``: the ``k`` rows of largest inner product to each query.

    ``asked`` is a condition on ``vec_id`` that picks the queries; a query's candidates are
    all rows of another id whose vector is as long as its own. Rows whose id or vector is
    null, or whose vector is zero or holds null or non-finite components, take no part. Rows
    that repeat an id count once in a result, with their best score. How many buckets are
    probed is fitted on ``SAMPLE`` queries, whose true neighbours are found among all rows,
    so that ``recall`` of those are met; all rows are filed and all queries run. The share
    that is met of the neighbours of ``SAMPLE`` other queries is in the column ``recall``. A
    query that meets fewer than ``k`` rows is compared with all of them, and so are queries
    of any but the commonest number of components.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "array<double>"
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = clean.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(norm).alias("low"), F.max(norm).alias("high"))
    top, *more = stats.orderBy(F.desc("n"), "d").limit(2).collect() or [None]
    columns = ["query_id", "rank", "vec_id", "score", "recall"]
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double")
    found = _indexed(clean.where(F.size("embedding") == top.d), asked, k, recall, top).select(*columns)
    if more:
        others = clean.where(F.size("embedding") != top.d)
        by_length = [F.lit(0).alias("t"), F.size("embedding").cast("long").alias("bucket"), *(F.col(c).alias(c) for c in ("vec_id", "embedding"))]
        found = found.unionByName(_best(_search(others.select(*by_length), others.where(asked).select(*by_length), k), k).withColumn("recall", F.lit(1.0)).select(*columns))
    return found


def _indexed(rows: DataFrame, asked, k: int, recall: float, top) -> DataFrame:
    queries = rows.where(asked)
    bits = min(MOST, math.ceil(math.log2(max(1, top.n / BLOCK))))
    index = CrossPolytope(top.d, bits, None if top.high - top.low <= 1e-5 * top.high else top.high)
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE).collect()
    probes, measured = index.buckets, 1.0
    true = _exact(rows, sample, k).select("query_id", "embedding").collect() if sample else []
    if true:
        by_id = {r.vec_id: r.embedding for r in sample}
        fitted = {r.vec_id for r in sample[: max(1, len(sample) // 2)]}
        pairs = np.array([by_id[r.query_id] for r in true], dtype=np.float64), np.array([r.embedding for r in true], dtype=np.float64)
        ranks, own = index.ranks(*pairs), np.array([r.query_id in fitted for r in true])
        if own.any():
            probes = int(np.sort(ranks[own])[min(own.sum() - 1, math.ceil(recall * own.sum()) - 1)])
        measured = float((ranks[~own] <= probes).mean()) if not own.all() else float((ranks <= probes).mean())
    found = written(_best(_search(*_filed(rows, queries, index, probes, TABLES), k), k), "neighbours")
    least = min(k, top.n - 1)
    full = found.groupBy("query_id").count().where(F.col("count") >= least)
    short = written(queries.join(full, queries["vec_id"] == full["query_id"], "left_anti"), "short")
    if not short.isEmpty():
        rest = _best(_search(*_filed(rows, short, index, index.buckets, 1), k), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.withColumn("recall", F.lit(measured))


def query(spark, sf_dir):
    """``op8_nearest``: 20 nearest vectors of each row of ``embeddings`` whose id is divisible by 20."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
