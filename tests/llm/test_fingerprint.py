import hashlib
import random

import numpy as np
from helpers import SF, documents

from gleaner.llm import fingerprint as P


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=repr)


def short(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert short(P.query(spark, SF)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(5, "é😀" * 30), (4, None), (3, ""), (9, "x" * 200_000), (None, "no id here, none"), (1, "abc"), (1, "abc"), (7, "one two three four five six")]
    assert short(P.document_fingerprints(documents(spark, rows))) == brute(rows)
    for some in (rows[:1], rows[:2]):
        assert short(P.document_fingerprints(documents(spark, some))) == brute(some)
    assert P.document_fingerprints(documents(spark, []).limit(0)).count() == 0


def test_likeness(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choices("abcdefgh ", k=4000))
    a = text()
    rows = [(4, a), (3, a), (2, text()), (1, text())]
    got = {r.doc_id: r for r in P.document_fingerprints(documents(spark, rows)).collect()}
    assert got[4].fingerprint == got[3].fingerprint and got[4].near_next == 1.0
    assert 0.3 < got[2].near_edited < 0.7 and got[2].near_next < 0.1
    assert got[2].near_edited < 1 and got[4].near_edited >= 0.5


def alike(a, b):
    """Share of both texts in common substrings that count, all of them tried."""
    if a == b:
        return 1.0
    held = [[False] * len(a), [False] * len(b)]
    for x in range(len(a)):
        for y in range(len(b)):
            if x and y and a[x - 1] == b[y - 1]:
                continue
            n = 0
            while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                n += 1
            if n >= P.SPAN:
                held[0][x : x + n], held[1][y : y + n] = [True] * n, [True] * n
    return min(sum(map(sum, held)), len(a) + len(b) - 1) / (len(a) + len(b))


def test_likeness_equals_brute_force():
    """Where a sketch holds all spans, once each, every common span is found."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    for _ in range(60):
        shared = [word(rng.randrange(1, 25)) for _ in range(3)]
        a, b = ("".join(x for y in rng.sample(shared, 2) for x in (y, word(rng.randrange(8)))) for _ in range(2))
        if rng.random() < 0.2:
            a = a[: rng.randrange(14)]
        if rng.random() < 0.1:
            b = a
        assert max(len(a), len(b)) <= P.KEPT + P.SPAN
        h = P.PrefixHashes(["before", a, "", b, "after"])
        assert P.likeness(h, P.sketches(h), [(1, 3), (3, 1), (2, 2), (2, 0)]) == [alike(a, b), alike(b, a), 1.0, 0.0]


def test_long_texts_that_differ_are_not_equal(spark):
    long = "".join(random.Random(2).choices("abcdefgh ", k=300_000))
    other = long[:150_000] + "#" + long[150_001:]
    got = {r.doc_id: r for r in P.document_fingerprints(documents(spark, [(3, long), (2, other), (1, long)])).collect()}
    assert 0.999 < got[3].near_next < 1.0 and 0.999 < got[2].near_next < 1.0 and got[1].near_next == 1.0


def test_buckets_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 2000)
    rows = [(i, f"text {i} " * 20) for i in range(300)]
    docs = documents(spark, rows)
    assert short(P.document_fingerprints(docs)) == brute(rows)
    assert P.chained(docs).rdd.getNumPartitions() > 20


def test_spans_and_extensions_equal_brute_force():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab"), n)) for n in (0, 1, 50, 400, 400)] + ["abab" * 60, "abab" * 60 + "b"]
    joined = "".join(texts)
    h = P.PrefixHashes(texts)
    a, b = rng.integers(0, len(joined), 500), rng.integers(0, len(joined), 500)
    most = len(joined) - np.maximum(a, b)
    n = np.minimum(rng.integers(0, 6, 500), most)
    assert h.equal(a, b, n).tolist() == [joined[x : x + k] == joined[y : y + k] for x, y, k in zip(a, b, n)]

    def common(x, y):
        k = 0
        while max(x, y) + k < len(joined) and joined[x + k] == joined[y + k]:
            k += 1
        return k

    assert h.extension(a, b, most).tolist() == [common(x, y) for x, y in zip(a, b)]

    def behind(x, y):
        k = 0
        while min(x, y) - k > 0 and joined[x - k - 1] == joined[y - k - 1]:
            k += 1
        return k

    assert h.extension(a, b, np.minimum(a, b), back=True).tolist() == [behind(x, y) for x, y in zip(a, b)]
