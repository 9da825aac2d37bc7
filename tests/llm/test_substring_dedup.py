import random
import re

import numpy as np
from helpers import SF, documents, duck, rows

from gleaner.llm import substring_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k=20):
    least = -(1 << 63)
    split = [(least if i is None else i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (doc_id, _), (i, w) in zip(docs, split):
        gone = {s + j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < (i, s) for j in range(k)}
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=repr)


def corpus(seed, n=60, vocabulary=50):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}é"
    passages = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [word() for _ in range(rng.randrange(0, 80))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = p[rng.randrange(5) :]
        docs.append((i, rng.choice([" ", "\n", "\t  "]).join(parts)))
    return docs


def test_small_corpora_equal_brute_force(spark, monkeypatch):
    for seed, chunk, bucket, places in ((1, 6 << 20, 8 << 20, 100), (2, 500, 700, 1000), (3, 3000, 200, 7)):
        monkeypatch.setattr(D, "CHUNK", chunk)
        monkeypatch.setattr(D, "BUCKET", bucket)
        monkeypatch.setattr(D, "PLACES", places)
        docs = corpus(seed)
        assert got(D.substring_dedup(documents(spark, docs).repartition(3))) == brute(docs)


def test_awkward_rows(spark):
    line = " ".join(f"x{i}" for i in range(30))
    docs = [(5, None), (4, ""), (3, line), (2, line + " tail"), (None, line), (8, "a " * 5000), (9, "b a " * 3000), (7, line), (7, line), (1, "z" * 100_000)]
    assert got(D.substring_dedup(documents(spark, docs))) == brute(docs)
    assert D.substring_dedup(documents(spark, docs).limit(0)).count() == 0
    wide = documents(spark, [(1, "a b", 7, "k")], "doc_id long, text string, start int, n_words string")
    assert D.substring_dedup(wide).columns == ["doc_id", "text", "start", "n_words", "n_removed"]


def test_query_equals_sql(spark):
    assert rows(D.query(spark, SF)) == duck(D.SQL, SF)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "_spans", lambda values, start, end: np.zeros(len(start), np.uint64))
    hashes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], dtype=np.uint64)
    windows = np.array([0, 3, 6])
    assert D.later(hashes, windows, 3, np.array([1, 2, 3]), np.zeros(3, np.int64)).tolist() == [False, False, True]




def test_windows_of_common_runs_are_split(spark, monkeypatch):
    """A run that very many windows hold, and no rarer one beside it, goes to several buckets; results are the same."""
    monkeypatch.setattr(D, "BUCKET", 2000)
    monkeypatch.setattr(D, "COUNTERS", (6, 6))
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(400)))) for i in range(60)]
    found = D.frequencies(documents(spark, docs), 10)
    assert found.parts.max() > 1
    assert got(D.substring_dedup(documents(spark, docs))) == brute(docs)


def test_orders_of_runs_are_one_to_one():
    rng = np.random.default_rng(1)
    found = D.Frequencies(rng.integers(0, 1000, 1 << 8))
    mers = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    assert len(np.unique(found.ordered(mers))) == len(mers)
    times = np.zeros(1 << 8, np.int64)
    times[7] = 10**9
    common = D.Frequencies(times)
    split = common.split(common.ordered(mers))
    assert (split[(mers & np.uint64(255)) == 7] > 1).all() and (split[(mers & np.uint64(255)) != 7] == 1).all()
