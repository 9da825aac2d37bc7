import random
import tracemalloc
import zlib

import numpy as np
import pytest
import sentencepiece
from helpers import SF, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from gleaner.llm import pieces as P

MODEL = path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def written(items):
    out = b""
    for number, kind, value in items:
        out += varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value)
    return out


def as_unigram(data):
    """The same pieces and scores, to be segmented by the largest total score."""
    items = [(n, k, written([(a, b, P.UNIGRAM if a == 3 else c) for a, b, c in P.fields(v)]) if n == 2 else v) for n, k, v in P.fields(data)]
    return written(items)


@pytest.fixture(scope="module")
def models():
    with open(MODEL, "rb") as f:
        data = f.read()
    return [(P.PieceModel(d), sentencepiece.SentencePieceProcessor(model_proto=d)) for d in (data, as_unigram(data))]


def ids_of(model, text):
    tool = P.Encoder(MODEL)
    tool.model = model
    return [x.tolist() for x in tool.encode([text])[0]]


def total(model, ids):
    """The score of a path, exactly: the library adds in single precision and may miss the best one by a hair."""
    return sum(model.scores[i] if model.kinds[i] == P.NORMAL else model.worst for i in ids)


def test_best_path_equals_brute_force(models):
    unigram = models[1][0]

    def best(word):
        if not word:
            return 0.0
        parts = [(word[:n], word[n:]) for n in range(1, len(word) + 1)]
        return max(
            (unigram.scores[unigram.by_text[a]] if a in unigram.by_text else unigram.worst) + best(b)
            for a, b in parts
            if a in unigram.by_text or len(a) == 1
        )

    rng = random.Random(8)
    for _ in range(150):
        text = "".join(rng.choices("theinds", k=rng.randrange(1, 11)))
        assert total(unigram, ids_of(unigram, text)[1]) == best(P.BLANK + text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeinorst  .,'\n\té½語😀▁A1")), max_size=60))
def test_both_segmentations_equal_the_library(models, text):
    if P.BLANK in text:
        return
    (pairs, library), (unigram, best) = models
    own, path_ids = ids_of(pairs, text)
    assert own == library.encode(text)
    assert path_ids == ids_of(unigram, text)[0]
    assert total(unigram, path_ids) >= total(unigram, best.encode(text))
    assert pairs.decode(own) == text and pairs.decode(path_ids) == text


def test_long_words_equal_the_library(models):
    rng = random.Random(4)
    for n in (95, 96, 97, 300, 3000):
        text = "".join(rng.choices("theandingionre", k=n))
        assert ids_of(models[0][0], text)[0] == models[0][1].encode(text)


def test_very_long_words_in_windows(models, monkeypatch):
    """Cut or not, and in windows of any size, both encodings are those of the whole word."""
    rng = random.Random(6)
    (pairs, library), (unigram, _) = models
    texts = ["".join(rng.choices(s, k=n)) for s in ("theandingionre", "abcdefghijklmnopqrstuvwxyzé語", "a", "ab", "q語") for n in (700, 3001)]
    whole = [(ids_of(pairs, t), ids_of(unigram, t)) for t in texts]
    for window in (50, 128, 1000):
        monkeypatch.setattr(P, "WINDOW", window)
        for t, (own, best) in zip(texts, whole):
            assert ids_of(pairs, t) == own == [library.encode(t), best[0]]
            word = pairs.ready(t)
            assert "".join(pairs.parts(word)) == word
            assert np.array_equal(unigram._slow_ids(word, unigram.viterbi_long(word)), np.array(best[0], "<u4").tobytes())
    assert len(list(pairs.parts(pairs.ready(texts[2])))) > 20


def test_memory_of_a_very_long_word_is_bounded(models):
    text = "".join(random.Random(1).choices("theandingionrequxz", k=1_000_000))
    tracemalloc.start()
    own, best = ids_of(models[0][0], text)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert models[0][0].decode(own) == models[0][0].decode(best) == text
    assert held < 150e6


def test_query_equals_the_library(spark, models):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = P.query(spark, SF).collect()
    assert len(got) == len(texts)
    unigram, library = models[1]
    for r in got:
        want = np.array(models[0][1].encode(texts[r.doc_id]), dtype="<u4")
        assert (r.n_ids, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
        assert r.round_trip
        own = ids_of(unigram, texts[r.doc_id])[0]
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r.best_crc32
        assert total(unigram, own) >= total(unigram, library.encode(texts[r.doc_id]))


def test_awkward_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "word " * 50_000, 3), (None, "x", 3), (4, "tie", 3), (4, "tie", 3)]
    docs = documents(spark, rows, "doc_id long, text string, ids int")
    out = P.encoded(docs, MODEL)
    assert out.columns == ["doc_id", "text", "ids", "best_ids"]
    back = out.select("text", P.decoded(MODEL)("ids").alias("a"), P.decoded(MODEL)("best_ids").alias("b")).collect()
    assert all((r.text or "") == r.a == r.b for r in back) and len(back) == len(rows)
    assert P.summaries(docs.limit(0), MODEL).count() == 0
