import random

import numpy as np
import pytest
from helpers import SF, documents, duck, rows

from gleaner.llm import jaccard_join as J


def brute(docs, k, per_cent):
    least = -(1 << 63)
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((least if i is None else i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= per_cent * len(s | t):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets)


def got(df):
    return sorted((r.id, r.n, r.component) for r in df.collect())


def corpus(seed, n=150):
    """Families of near copies about the limit, exact copies, a passage that many share, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    bases = [[word() for _ in range(rng.choice([3, 6, 12, 30, 60, 120, 250]))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w += passage
        if rng.random() < 0.2:
            w = w[: rng.randrange(len(w) + 1)]
        out.append((i, rng.choice([" ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return out


@pytest.mark.parametrize(("seed", "k", "per_cent", "block", "meet"), [(1, 3, 90, 4096, 4096), (2, 5, 80, 4096, 4096), (3, 3, 80, 8, 4), (4, 1, 50, 16, 3), (5, 5, 80, 2, 4096)])
def test_small_corpora_equal_brute_force(spark, monkeypatch, seed, k, per_cent, block, meet):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "MEET", meet)
    docs = corpus(seed)
    assert got(J.jaccard_components(documents(spark, docs).repartition(3), k, per_cent)) == brute(docs, k, per_cent)


def test_large_families_of_hubs_and_chains(spark, monkeypatch):
    """Copies that link only to their base, copies that link to the next one, and copies that just don't link."""
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    docs, chain = [], list(base)
    for i in range(60):
        copy = list(base)
        for x in rng.sample(range(100), rng.choice([2, 3, 4])):
            copy[x] = f"n{i}-{x}"
        chain[rng.randrange(100)] = f"c{i}"
        docs += [(i, " ".join(copy)), (1000 + i, " ".join(chain))]
    docs.append((5000, " ".join(base)))
    expected = brute(docs, 3, 80)
    assert got(J.jaccard_components(documents(spark, docs).repartition(3), 3, 80)) == expected
    assert 1 < len({c for _, _, c in expected}) < len(docs)


def test_query_equals_sql(spark):
    assert rows(J.query(spark, SF)) == duck(J.SQL, SF)


def test_awkward_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    docs = [(9, None), (8, ""), (7, "one"), (6, "ONE"), (5, "one two"), (4, long), (3, long + " end"), (None, "one two three four"), (2, "é É"), (1, "é é"), (11, "same text here ok"), (11, "same text here ok")]
    assert got(J.jaccard_components(documents(spark, docs), 3, 90)) == brute(docs, 3, 90)
    assert J.jaccard_components(documents(spark, docs).limit(0)).count() == 0


def test_rows_of_null_or_repeated_ids(spark):
    schema = "doc_id long, text string, handle string, id int, n int, root int"
    same = "one two three four five six"
    docs = [(None, same), (None, "other words than those of the first"), (None, same), (3, same), (3, same), (2, same), (4, None), (4, None), (5, " "), (None, "x y")]
    table = documents(spark, [(*d, "h", 1, 2, 3) for d in docs], schema)
    least = -(1 << 63)
    assert got(J.jaccard_components(table, 5, 80)) == sorted(
        [(least, 2, least), (least, 2, least), (least, 3, least), (least, 1, least), (2, 2, least), (3, 2, least), (3, 2, least), (4, 0, 4), (4, 0, 4), (5, 0, 5)]
    )
    kept = J.representatives(table, 5, 80)
    assert kept.columns == table.columns
    expected = [(2, same), (4, None), (4, None), (5, " "), (None, "other words than those of the first"), (None, "x y")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)
    assert J.representatives(table.limit(0), 5, 80).count() == 0


def test_sets_that_link_share_a_signature():
    rng = np.random.default_rng(1)
    rank = rng.permutation(J.RANKS).astype(np.uint64)
    for per_cent in (50, 80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 20, 40, 100, 333):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
                gone = rng.integers(0, n + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, rng.integers(0, n + 1)).astype(np.uint64) * np.uint64(2)]))
                both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if len(b) and 100 * both >= per_cent * either:
                    assert set(J.signatures(a, rank, per_cent).tolist()) & set(J.signatures(b, rank, per_cent).tolist())


@pytest.mark.parametrize("n", [300, 1100, 5000])
def test_tree_bound_is_lossless(n):
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(n // 2, n)], rng.integers(0, 1 << 63, rng.integers(1, n // 5)).astype(np.uint64)])) for _ in range(200)]
    coordinates, sizes = J.points(sets), np.array([len(s) for s in sets])
    tree = J.Points(coordinates, sizes, 80)
    for i in range(0, 200, 7):
        near = set(tree.near(i, np.ones(200, bool)).tolist())
        assert near >= {j for j, s in enumerate(sets) if 100 * len(np.intersect1d(s, sets[i])) >= 80 * len(np.union1d(s, sets[i]))}
        some = rng.random(200) < 0.2
        assert set(tree.near(i, some).tolist()) == {j for j in near if some[j]}


def test_points_tell_unlike_sets_of_any_size_apart():
    rng = np.random.default_rng(3)
    for n in (100, 1000, 1030, 20_000):
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(6)]
        tree = J.Points(J.points(sets), np.array([len(s) for s in sets]), 80)
        assert all(tree.near(i, np.ones(6, bool)).tolist() == [i] for i in range(6))
        fewer = J.folded(J.points(sets)[0], 64)
        assert len(fewer) == 64 and fewer.sum() == len(sets[0])


def test_points_are_kept_whole():
    rng = np.random.default_rng(8)
    for most in (3, 255, 256, 60_000):
        point = rng.integers(0, most + 1, 128).astype("<u2")
        point[5] = most
        assert J._unpacked(J._packed(point)).tolist() == point.tolist()
