
import corpus_pipeline as C
from helpers import SF
from test_jaccard_join import brute as near
from test_line_dedup import brute as deduped
from test_packing import check as packed
from test_secret_scan import brute as secrets

from gleaner.llm import language_id


def read(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_does_its_part(spark, tmp_path):
    assert [n for n, _ in C.STAGES] == ["language", "lines", "near_duplicates", "secrets", "sequences"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(C.STAGES)

    spoken = read(spark, stage["language"](spark, docs, SF), tmp_path, "a")
    tool = language_id.Classifier(language_id.dictionaries(docs))
    judged = {i: tool.judge(t) for i, t in texts(docs).items()}
    assert texts(spoken) == {i: t for i, t in texts(docs).items() if judged[i][0] != "und" and judged[i][2] >= 0.01}

    lines = read(spark, stage["lines"](spark, spoken, SF), tmp_path, "b")
    assert texts(lines) == {i: t for i, _, _, t in deduped(list(texts(spoken).items()))}

    alone = read(spark, stage["near_duplicates"](spark, lines, SF), tmp_path, "c")
    first = {i for i, _, c in near(list(texts(lines).items()), 5, 80) if i == c}
    assert texts(alone) == {i: t for i, t in texts(lines).items() if i in first}

    clean = read(spark, stage["secrets"](spark, alone, SF), tmp_path, "d")
    assert set(texts(clean)) == set(texts(alone))
    for i, t in texts(clean).items():
        assert not secrets(t.replace("[SECRET]", "")) or not secrets(t)
        if not secrets(texts(alone)[i]) and "[SECRET]" not in t:
            assert t == texts(alone)[i]

    for df in (spoken, lines, alone, clean):
        assert df.dtypes == docs.dtypes
        assert all(r.n_chars == len(r.text) for r in df.collect())
    packed(stage["sequences"](spark, clean, SF).collect(), list(texts(clean).items()))


def test_run_equals_the_stages(spark):
    rows = C.run(spark, SF).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, base string, spans int, n_lines int, row int, score int, piece int"
LINE = "a line that is long enough to be counted by the stage of lines"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    words = "the house of the old man is near the river and the wood "
    docs = [(i, words * (i + 1) + f"number {i} token=abcdefghijkl{i:03d}", "en") for i in range(12)]
    docs += [(100 + i, f"{LINE}\n" + " ".join(f"{w}{i}" for w in words.split()), "en") for i in range(6)]
    docs += [(200, None, "en"), (201, "", "en"), (202, " \n ", None), (203, "12 34 !!", "de"), (None, words + "without an id", None), (None, None, None), (None, words + "without an id", None)]
    docs += [(300, "das haus und der wald sind alt und das wasser ist kalt " * 3, "de"), (301, "wort " * 60_000, "de"), (302, "x" * 300_000, None)]
    docs += [(400, words + "twice", "en")] * 2
    rows = [(i, t, lang, None if n % 3 else "web", None if t is None else len(t), f"b{n}", n, 2 * n, 3 * n, 4 * n, 5 * n) for n, (i, t, lang) in enumerate(docs)]
    return spark.createDataFrame(rows, EXTRA)


def others(df):
    return sorted((tuple(r[5:]) for r in df.collect()), key=repr)


def test_awkward_rows_in_every_stage(spark, tmp_path):
    docs = awkward(spark)
    rows = docs.collect()
    stage = dict(C.STAGES)
    for name, make in C.STAGES[:-1]:
        empty = make(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert stage["sequences"](spark, docs.limit(0), SF).count() == 0

    spoken = stage["language"](spark, docs, SF)
    assert spoken.dtypes == docs.dtypes and set(others(spoken)) <= set(others(docs))
    assert not {200, 201, 202, 203} & {r.doc_id for r in spoken.collect()}
    assert stage["language"](spark, docs.withColumn("lang", docs.lang.substr(9, 9)).where("lang = 'x'"), SF).count() == 0

    lines = stage["lines"](spark, docs, SF)
    assert lines.dtypes == docs.dtypes and others(lines) == others(docs)
    before = {r.spans: r.text for r in rows}
    for r in lines.collect():
        want = before[r.spans] if not r.doc_id or r.doc_id not in range(100, 105) else before[r.spans].removeprefix(f"{LINE}\n")
        assert r.text == want and r.n_chars == (None if want is None else len(want))

    alone = stage["near_duplicates"](spark, docs, SF)
    assert alone.dtypes == docs.dtypes and set(others(alone)) <= set(others(docs))
    numbered = [(n if r.doc_id is None else r.doc_id * 1000, r.text) for n, r in enumerate(rows)]  # ids of their own for null ones
    kept = sorted((repr(r.doc_id), r.text) for r in alone.collect() if r.text and r.text.split())
    first = {}
    for (i, text), (_, n, c) in zip(sorted(numbered, key=lambda x: x[0]), near(numbered, 5, 80)):
        if n:
            first.setdefault(c, []).append((i < 1000, i, text))
    assert len(kept) == len(first) and {t for _, t in kept} == {min(m)[2] for m in first.values()}
    assert sum(not (r.text or "").split() for r in alone.collect()) == sum(not (r.text or "").split() for r in rows)

    clean = stage["secrets"](spark, docs, SF)
    assert clean.dtypes == docs.dtypes and others(clean) == others(docs)
    for r in clean.collect():
        if r.doc_id is not None and r.doc_id < 12:
            assert r.text == before[r.spans].split("token=")[0] + "[SECRET]"
        elif before[r.spans] is None or len(before[r.spans]) < 1000:
            assert r.text == before[r.spans]
        assert r.n_chars == (None if r.text is None else len(r.text))

    packed(stage["sequences"](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in rows])
