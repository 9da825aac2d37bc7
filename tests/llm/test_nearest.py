import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from gleaner.llm import nearest as N


def brute(rows, asked, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if asked(i):
            seen = sorted({(-float((v * w).sum()), j) for j, w in ok if j != i})
            out[i] = seen[:k]
    return out


def recall(got, want):
    met = sum(len({j for _, j in w} & {r.vec_id for r in got if r.query_id == i}) for i, w in want.items())
    return met / sum(len(w) for w in want.values())


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    got = N.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect()
    want = brute([(i, v.tolist()) for i, v in rows.items()], lambda i: i % 20 == 0, 20)
    assert recall(got, want) >= 0.9
    assert len(got) == 20 * len(want)
    for r in got:
        assert abs(r.score - float((rows[r.query_id] * rows[r.vec_id]).sum())) < 1e-12
    for i in want:
        mine = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == i)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_awkward_rows_and_unequal_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 9)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (460, [float("nan")] + [1.0] * 5), (480, [float("inf")] + [1.0] * 5), (500, []), (520, [1.0]), (None, [1.0] * 6)]
    rows += [(600, [1.0] * 6)] * 2 + [(i, [2.0] * 6) for i in range(601, 640)]
    rows += [(700 + i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    got = N.nearest_neighbours(documents(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    of = lambda n: brute([r for r in rows if r[1] and len(r[1]) == n], lambda i: i % 20 == 0, 20)
    want = of(6)
    assert {r.query_id for r in got} == set(want) | set(of(4))
    assert recall([r for r in got if 700 <= r.query_id], of(4)) == 1.0
    assert recall(got, want) >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 600][:3] == [j for _, j in want[600][:3]]


def test_few_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    frame = documents(spark, rows, "vec_id long, embedding array<float>")
    got = N.nearest_neighbours(frame, F.col("vec_id") % 2 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(
        (i, n + 1, j) for i, w in brute(rows, lambda i: i % 2 == 0, 20).items() for n, (_, j) in enumerate(w)
    )
    assert N.nearest_neighbours(frame.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert N.nearest_neighbours(frame, F.col("vec_id") > 99).count() == 0


def test_doubles_stay_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.1, 0.0]), (2, [0.1 + 1e-12, 0.0])]
    got = N.nearest_neighbours(documents(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 0.1 + 1e-12), (1, 0.1)]


def test_rotations_keep_lengths_and_pairs_of_axes_work():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 20))
    for bits, buckets in ((0, 64), (6, 64), (7, 128), (9, 512), (12, 4096)):
        index = N.CrossPolytope(20, bits, 9.0)
        assert index.buckets == buckets
        assert np.allclose((index.turned(index.unit(x, True), 0, 0) ** 2).sum(1), 2)
        filed = index.file(x)
        assert filed.max() < index.buckets and (index.probe(x, 0, 3).shape) == (500, 3)
        near = index.ranks(x, x + 0.01 * rng.normal(size=x.shape))
        assert np.median(near) < 0.05 * index.buckets


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(120)] + [(i, [0.0, float(i % 7), 1.0]) for i in range(200, 260)]
    got = N.nearest_neighbours(documents(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert recall([r for r in got if r.query_id < 120], {i: w for i, w in want.items() if i < 120}) == 1.0


def test_more_buckets_keep_the_recall(spark, monkeypatch):
    """Rows in many more buckets than one rotation has: the recall holds on queries that nothing was fitted on."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SAMPLE", 32)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    x = (centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 12))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = N.nearest_neighbours(documents(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 40 == 0).collect()
    assert N.CrossPolytope(12, 10, 1.0).axes == [32, 32]
    want = brute(rows, lambda i: i % 40 == 0, 20)
    assert recall(got, want) >= 0.9
    assert abs(got[0].recall - recall(got, want)) < 0.08
