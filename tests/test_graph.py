import random

from pyspark.sql import functions as F

from gleaner.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {x: top(x) for x in up}


def found(df):
    rows = df.collect()
    out = {r.node: r.component for r in rows}
    assert len(out) == len(rows)
    return out


def test_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 299), (299, 300)]
    assert found(graph.components(frame(spark, edges))) == brute(edges)
    assert graph.components(frame(spark, edges).limit(0)).count() == 0


def test_random_graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    assert found(graph.components(frame(spark, edges))) == brute(edges)
    turned = frame(spark, [(b, a) for a, b in reversed(edges)]).withColumn("a", F.col("a"))
    assert found(graph.components(turned)) == brute(edges)


def test_settled_edges_are_known_by_one_shuffle(spark, monkeypatch):
    plans, empty = [], type(spark.range(0)).isEmpty
    monkeypatch.setattr(type(spark.range(0)), "isEmpty", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or empty(df))
    cases = [([(2, 1), (3, 1), (5, 4)], False), ([(3, 1), (3, 2)], True), ([(2, 1), (3, 2)], True), ([(4, 1), (3, 2), (4, 3)], True)]
    assert [graph._unsettled(frame(spark, e)) for e, _ in cases] == [w for _, w in cases]
    assert max(p.count("Exchange") for p in plans) == 1
