import random
import zlib
from collections import defaultdict

import numpy as np
from helpers import SF, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from gleaner.llm import packing as P

VOCABULARY = path("byte_bpe_50k.json")


def encoder():
    tool = Tokenizer.from_file(VOCABULARY)
    return lambda t: tool.encode(t, add_special_tokens=False).ids


def check(rows, texts, capacity=2048):
    """Rows of the query against brute force; returns the number of sequences."""
    encode = encoder()
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = encode(text or "") + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id].append((piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = P.query(spark, SF).collect()
    n = check(rows, texts)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_awkward_rows(spark):
    texts = [(1, None), (2, ""), (3, "long words " * 30_000), (None, "no id"), (4, "twice"), (4, "twice"), (5, "\n\n  é \t x"), (6, "a <|endoftext|> b"), (7, "<|endoftext|>" * 3000)]
    out = P.pack(P.pieces(documents(spark, texts), VOCABULARY))
    check(out.collect(), texts)
    assert P.pack(P.pieces(documents(spark, []).limit(0), VOCABULARY)).count() == 0


def test_exchange_saves_sequences(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.choice([700, 900, 1100, 1300, 500]), i) for i in range(900)]
    items = documents(spark, rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    count = lambda df: df.select("sequence_id").distinct().count()
    alone, exchanged = count(P.pack(items, target=30, rounds=0)), count(P.pack(items, target=30))
    assert exchanged < alone
    out = P.pack(items, target=30).collect()
    assert sorted(r.doc_id for r in out) == list(range(900))


def test_certified_partitions_stay_closed(spark):
    """Sequences over half full of partitions that need as many as they have are not exchanged; others are."""
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rng = random.Random(4)
    alike = documents(spark, [(i, 0, 0, 1100, i) for i in range(400)], columns)
    first = {(r.doc_id, r.sequence_id) for r in P.pack(alike, target=40, rounds=0).collect()}
    assert {(r.doc_id, r.sequence_id) for r in P.pack(alike, target=40).collect()} == first
    mixed = documents(spark, [(i, 0, 0, rng.choice([1100, 900, 700, 500, 300]), i) for i in range(600)], columns)
    before = {r.doc_id: r for r in P.pack(mixed, target=40, rounds=0).collect()}
    after = P.pack(mixed, target=40, rounds=1).collect()
    closed = [r for r in after if before[r.doc_id].bins == before[r.doc_id].bound and 2 * before[r.doc_id].fill > 2048]
    moved = [r for r in after if before[r.doc_id].bins > before[r.doc_id].bound and before[r.doc_id].fill < 2048]
    assert closed and all(r.sequence_id == before[r.doc_id].sequence_id for r in closed)
    assert moved and all(r.sequence_id != before[r.doc_id].sequence_id for r in moved)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sZé½²٠_.,!\n\t \x1c\u0085 　語😀")), max_size=40))
def test_ids_equal_the_library(text):
    if not hasattr(test_ids_equal_the_library, "tools"):
        test_ids_equal_the_library.tools = P.Ids(VOCABULARY), encoder()
    ids, encode = test_ids_equal_the_library.tools
    assert np.frombuffer(ids.encode(text), dtype="<u4").tolist() == encode(text)


COMMON = [*map(chr, (10, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028)))]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet=st.sampled_from(COMMON), max_size=60), st.text(alphabet=st.sampled_from(list(" \n'sltd1½.a")), max_size=60)))
def test_ids_of_common_characters_equal_the_library(text):
    assert P.common(text) == (" " * 9 not in text.replace("\n", " "))
    if not hasattr(test_ids_of_common_characters_equal_the_library, "tools"):
        test_ids_of_common_characters_equal_the_library.tools = P.Ids(VOCABULARY), encoder()
    ids, encode = test_ids_of_common_characters_equal_the_library.tools
    assert np.frombuffer(ids.encode(text), dtype="<u4").tolist() == encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_never_exceeds_the_best_packing(sizes):
    def best(i, bins):
        if i == len(sizes):
            return len(bins)
        options = [best(i + 1, [*bins[:j], b + sizes[i], *bins[j + 1 :]]) for j, b in enumerate(bins) if b + sizes[i] <= 20]
        return min([*options, best(i + 1, [*bins, sizes[i]])])

    sizes = sizes[:7]
    x, n = np.unique(sizes, return_counts=True)
    exact = best(0, [])
    bins, _ = P.best_fit_decreasing(np.array(sizes), 20)
    assert P.lower_bound(x, n, 20) <= exact <= bins.max() + 1
