"""Near-duplicate groups against brute force, where blocks are small and groups large."""

import random

import pytest

from gleaner.operators import detectors, similar

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def apart(x, y):
    return min(64, -int(-(((x[0] ^ y[0]) & MASK).bit_count() + 0.7 * ((x[1] ^ y[1]) & MASK).bit_count()) // 1))


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def corpus(seed, n=160):
    """Chains whose ends are far apart, tight groups, equal prints and lone ones."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        p, d = rng.getrandbits(64), rng.getrandbits(64)
        kind = rng.choice(["chain", "tight", "equal", "alone"])
        for _ in range({"chain": 12, "tight": 9, "equal": 3, "alone": 1}[kind]):
            out.append((p, d))
            if kind == "chain":
                p, d = flipped(rng, p, rng.choice([3, 5, 6])), flipped(rng, d, rng.choice([0, 2, 5]))
            elif kind == "tight":
                out.append((flipped(rng, p, 2), flipped(rng, d, 2)))
    return [(i, signed(p), signed(d)) for i, (p, d) in enumerate(out)]


def joined(ids, linked):
    left, out = set(ids), {}
    for first in sorted(ids):
        if first in left:
            left.discard(first)
            queue = [first]
            while queue:
                x = queue.pop()
                out[x] = first
                new = [y for y in left if linked(x, y)]
                left.difference_update(new)
                queue += new
    return out


def brute(rows):
    at = {i: (p, d) for i, p, d in rows}
    s = lambda x, y: 1 - apart(at[x], at[y]) / 64
    component = joined(at, lambda x, y: apart(at[x], at[y]) <= 10)
    out = {}
    for c in set(component.values()):
        own = [i for i in at if component[i] == c]
        weak = len(own) > 2 and any(s(x, y) < 0.65 for x in own for y in own)
        parts = joined(own, lambda x, y: s(x, y) >= 0.8) if weak else dict.fromkeys(own, c)
        for g in set(parts.values()):
            inside = [i for i in own if parts[i] == g]
            if len(inside) > 1:
                pairs = [s(x, y) for x in inside for y in inside if x < y]
                out |= {i: (g, len(inside), round(sum(pairs) / len(pairs), 9)) for i in inside}
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 4), (3, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = corpus(seed)
    got = similar.near_groups(spark.createDataFrame(rows, "id long, p long, d long")).collect()
    assert {r.id: (r.group_id, r.files, round(r.avg_similarity, 9)) for r in got} == brute(rows)
    assert len(got) == len({r.id for r in got})


@pytest.mark.parametrize("bands", [6, 7, 8, 9])
def test_any_number_of_bands_loses_no_pair(spark, monkeypatch, bands):
    monkeypatch.setattr(similar, "_banding", lambda rows, limit: bands)
    rows = corpus(5, 80)
    want = {(a, b, apart(x, y)) for a, *x in rows for b, *y in rows if a < b and apart(x, y) <= 10 and x != y}
    found = similar.near_pairs(similar.classes(spark.createDataFrame(rows, "id long, p long, d long"))).collect()
    first = {(p, d): i for i, p, d in reversed(rows)}
    assert {(r.a, r.b, r.distance) for r in found} == {w for w in want if all(first[rows[i][1:]] == i for i in w[:2])}


def test_bands_follow_the_rows():
    chosen = [similar._banding(n, 10) for n in (10, 10**4, 10**6, 10**8, 10**10)]
    assert chosen == sorted(chosen) and chosen[0] == 6 and chosen[-1] > 8
    for limit in range(11):
        a, b = similar._differing(limit)
        assert all(p <= a or d <= b for p in range(65) for d in range(65) if p + 0.7 * d <= limit)


def test_empty_table(spark):
    assert similar.near_groups(spark.createDataFrame([], "id long, p long, d long")).count() == 0


def test_companions_are_no_duplicates_of_each_other(spark):
    """A raw file and its JPEG are not a group; with a third like them, they are."""
    rng = random.Random(8)
    looks = [(signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for _ in range(4)]
    named = [("/a/IMG_1.CR2", 0), ("/a/IMG_1.jpg", 0), ("/b/IMG_2.NEF", 1), ("/b/IMG_2.jpeg", 1), ("/c/other.jpg", 1), ("/d/x.HEIC", 2), ("/d/x.MOV", 2), ("/e/y.jpg", 3), ("/f/z.CR2", 3)]
    rows = [(path, *looks[k]) for path, k in named]
    prints = spark.createDataFrame(rows, "id string, p long, d long")
    got = {}
    for r in similar.near_groups(prints, named=prints.selectExpr("id", "id AS path")).collect():
        got.setdefault(r.group_id, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [["/b/IMG_2.NEF", "/b/IMG_2.jpeg", "/c/other.jpg"], ["/e/y.jpg", "/f/z.CR2"]]


def test_detectors_and_sql_functions(spark):
    assert detectors.Pictures.of_mode("F").params() == "full"
    with pytest.raises(ValueError):
        detectors.Pictures.of_mode("")
    detectors.register(spark)
    rng = random.Random(3)
    rows = [tuple(signed(rng.getrandbits(64)) for _ in range(4)) for _ in range(50)]
    spark.createDataFrame(rows, "p long, d long, q long, e long").createOrReplaceTempView("prints")
    got = spark.sql("SELECT p, d, q, e, print_distance(p, d, q, e) AS n, print_similarity(print_distance(p, d, q, e)) AS s FROM prints").collect()
    assert all(r.n == apart((r.p, r.d), (r.q, r.e)) and r.s == 1 - r.n / 64 for r in got)
    prints = spark.createDataFrame([(1, 2, 3, [(2, 3), (4, 5)])], "id long, p long, d long, blocks array<struct<p:long,d:long>>")
    prints.createOrReplaceTempView("varied")
    want = [(0, 2, 3), (1, 4, 5)]
    assert [tuple(r) for r in spark.sql("SELECT v.* FROM varied, LATERAL variants(blocks) v ORDER BY k").collect()] == want
    assert [tuple(r)[1:] for r in detectors.Pictures().variants(prints).orderBy("k").collect()] == want
    entries = spark.createDataFrame([("/a.jpg", "ino:1", 5, "File"), ("/b.jpg", "ino:1", 5, "File"), ("/c.jpg", "ino:2", 5, "File"), ("/d.txt", "ino:3", 5, "File")], "path string, physical_key string, size_bytes long, kind string")
    assert sorted(r.path for r in detectors.Pictures().candidates(entries).collect()) == ["/a.jpg", "/c.jpg"]
    assert detectors.Pictures().candidates(entries.where("path < '/c'")).count() == 0


def test_groups_are_one_table_and_leave_no_other(spark):
    """Plans over groups read a written table, however often; distances of two full blocks take little more than their result."""
    import tracemalloc
    from pathlib import Path

    import numpy as np
    import pandas as pd

    from gleaner.operators.tables import shared_dir

    at = Path(shared_dir(spark).removeprefix("file:"))
    before = set(at.iterdir())
    members = similar.near_groups(spark.createDataFrame(corpus(5), "id long, p long, d long"))
    assert "FlatMapGroups" not in members._jdf.queryExecution().optimizedPlan().toString()
    left = [p.name.split("-")[0] for p in set(at.iterdir()) - before]
    assert left.count("members") == 1 and not {"classes", "reps", "sums", "weak", "apart", "parted", "groups"} & set(left)
    words = np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, (2, 2 * similar.BLOCK))
    tracemalloc.start()
    similar._distances(pd.DataFrame({"p": words[0], "d": words[1]}), False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6


def test_strong_edges_hang_on_the_least(spark):
    """A chain is joined by edges to its first class, which are components already: no further round reads them."""
    rng, p, rows = random.Random(3), 0, []
    for i in range(30):
        rows.append((100 - i, signed(p), 0, 1, 7))
        p ^= 3 << 2 * i
    rng.shuffle(rows)
    edges = similar._strong_edges(spark.createDataFrame(rows, "rep long, p long, d long, files long, component long"), "component")
    assert sorted((r.a, r.b) for r in edges.collect()) == [(71, i) for i in range(72, 101)]


def test_groups_query_reads_its_own_table(spark):
    """What is asked of groups reads no texts again."""
    from gleaner.plans import review

    found = review.QUERIES["near_duplicate_groups"](spark, "/root/testdata/sf0.001").inputFiles()
    assert found and all("/sized-" in f for f in found)


def test_groups_report_reads_its_own_table(spark):
    from gleaner.plans import records

    found = records.QUERIES["report_similar_groups"](spark, "/root/testdata/sf0.001").inputFiles()
    assert found and all("/sized-" in f for f in found)
