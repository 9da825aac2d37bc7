import re
import zlib

import zstandard
from helpers import SF, documents

from gleaner.llm import language_id as L


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = L.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert 0.25 < len(held) / len(got) < 0.42
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.accepted for r in got) / len(got) > 0.97


def test_awkward_rows(spark):
    found = L.dictionaries(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !!! ___", "x"), (4, "the and of " * 100_000, "x"), (None, "the and of", "x"), (4, "the", "x"), (4, "the", "x")]
    docs = documents(spark, rows, "doc_id long, text string, score string")
    got = L.language_id(docs, found).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3):
        assert (by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False)
    assert by[None].lang_pred in found
    assert L.language_id(docs.limit(0), found).count() == 0


def test_nothing_learned_and_bounded_sample(spark):
    docs = documents(spark, [(i, "le la des " * 50, "fr") for i in range(400)] + [(9, "das", None)], "doc_id long, text string, lang string")
    found = L.dictionaries(docs, pieces=8, piece_chars=10)
    assert set(found) == {"fr"} and len(found["fr"]) <= 8 * 11
    assert L.Classifier({}).judge("words")[0] == "und"
    assert L.Classifier(found).judge("le la")[0] == "fr"
    assert L.dictionaries(docs.limit(0)) == {}


def test_a_tie_is_not_accepted(spark):
    docs = documents(spark, [(1, "abc abc abc")])
    r = L.language_id(docs, {"a": b"same words here", "b": b"same words here"}).collect()[0]
    assert r.lang_pred == "a" and r.margin == 0 and not r.accepted


def test_labels_are_bounded(spark):
    rows = [(i, "la le les des " * 9, lang) for lang, ids in (("fr", range(200)), ("de", range(200, 330)), ("it", range(400, 440)), ("zz", range(500, 510))) for i in ids]
    docs = documents(spark, rows, "doc_id long, text string, lang string")
    assert set(L.dictionaries(docs, labels=2)) == {"fr", "de"} and set(L.dictionaries(docs)) == {"fr", "de", "it", "zz"}


def test_query_equals_brute_force(spark):
    """The same decision from the definition alone: smallest sum of compressed blocks, dictionaries from training rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = L.dictionaries(docs)
    trained = {r.lang for r in docs.collect() if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert set(found) == trained
    words = {lang: set(d.decode().split()) for lang, d in found.items()}
    seen = {lang: set(re.sub(r"[^\w]+|[\d_]+", " ", " ".join(r.text.lower() for r in docs.collect() if r.lang == lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)).split()) for lang in trained}
    for lang, own in words.items():  # but for words that an excerpt cuts, all are the training rows'
        assert len(own - seen[lang]) <= 2 * 256

    def size(block, lang):
        d = zstandard.ZstdCompressionDict(found[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, level=5, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.query(spark, SF).collect():
        data = re.sub(r"[^\w]+|[\d_]+", " ", (texts[r.doc_id] or "").lower()).strip().encode()
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not data:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        sizes = sorted((sum(size(data[i : i + 2048], lang) for i in range(0, len(data), 2048)), lang) for lang in found)
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert r.lang_pred == sizes[0][1] and r.accepted == (margin >= 0.01)
        assert abs(r.score - margin / (margin + 0.05)) < 1e-12
