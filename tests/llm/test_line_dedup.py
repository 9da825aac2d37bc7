import random
from collections import defaultdict

from helpers import SF, documents, duck, rows

from gleaner.llm import line_dedup as L

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars=40, min_docs=5):
    held = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def test_small_corpora_equal_brute_force(spark):
    rng = random.Random(3)
    lines = ["É" * 39 + "x", "Long enough to be counted as a line of its own", "short", "", "ÀÉÎ straße Über alles was lang genug ist, ja", "another line that is long enough to count here"]
    style = [str.upper, str.lower, lambda s: f"  {s}\t", lambda s: s]
    docs = [(i, "\n".join(rng.choice(style)(rng.choice(lines)) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    assert got(L.line_dedup(documents(spark, docs).repartition(3))) == brute(docs)
    assert got(L.line_dedup(documents(spark, docs), 5, 2)) == brute(docs, 5, 2)


def test_awkward_rows(spark):
    line = "this very line is in enough of the documents to go"
    docs = [(i, line) for i in range(6)] + [(5, line), (7, None), (8, ""), (None, line), (9, (line + "\n") * 5000), (10, "x" * 300_000), (11, "\n\n")]
    assert got(L.line_dedup(documents(spark, docs))) == brute(docs)
    assert L.line_dedup(documents(spark, docs).limit(0)).count() == 0
    wide = documents(spark, [(1, "a", 1, "x", 2)], "doc_id long, text string, h1 int, line string, n_lines int")
    assert L.line_dedup(wide).columns == ["doc_id", "text", "h1", "line", "n_lines", "n_dropped"]


def test_query_equals_sql(spark):
    assert rows(L.query(spark, SF)) == duck(L.SQL, SF)
