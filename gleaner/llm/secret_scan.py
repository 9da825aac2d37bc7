"""Secret scans, in DataFrame functions only.

Three fixed patterns give the base spans. Long opaque tokens outside of them face a battery
of randomness tests - chi-squared uniformity over the inferred alphabet, a runs test about
its middle and a lag-1 serial correlation - and those random enough are spans too. How
random that is, is settled for each encoding and length class by the Benjamini-Hochberg
rule: words of the same documents, written as tokens of that encoding and length, face the
same battery and tell how often text that is no secret looks as random, so that at most
``rate`` of the tokens reported are expected to be such text.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import table, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Both patterns take whole maximal runs, so a run that is too short holds no match at all.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
#: Parts of a run that fits no encoding: between its '=', then between what only one of the alphabets has.
#: Only at the end of a run is '=' padding.
VALUE = r"[A-Za-z0-9+/_-]+(?:=+$)?"
NARROWER = (r"[A-Za-z0-9_-]+(?:=+$)?", r"[A-Za-z0-9+/]+(?:=+$)?")
LONG = 20
#: Code points of a block that a text is cut into.
CUT = 1000
KINDS = ("assign", "access", "hex", "random")

#: Encodings a token may be in: pattern, symbols in order, symbols a cell of the chi-squared test holds.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 1),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 1),
    (r"^(?=.*[^a-z])[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 8),
    (r"^(?=.*[^a-z])[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 8),
)
#: -2 log10 p is kept as a whole number up to this one.
LAST_BIN = 60
#: Length classes of an encoding: two for each doubling, the last for all that are longer.
SIZES = 32
#: Pieces of ordinary words that are judged beside each token.
DECOYS = 20
FAR = 8.0  # standard deviations, where a test has nothing to vary

SPANS = "array<struct<s:int,o:int,e:int>>"
TOKENS = "array<struct<s:int,e:int,t:string>>"


def _let(value, body):
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(array, combine, zero):
    """``combine`` over each element and all before it, in a number of passes that grows with the logarithm."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(array), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))

    def step(acc, k):
        n = F.least(k, F.size(acc))
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(zero), n), F.slice(acc, F.lit(1), F.size(acc) - n)), combine)

    return F.aggregate(steps, array, step)


def _found(text, pattern, make, kind, keep=None):
    """The matches of ``pattern`` as structs in order; the gaps between them give the positions."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("g"))

    def placed(x):
        steps = F.zip_with(x["h"], F.slice(x["g"], F.lit(1), F.size(x["h"])), lambda h, g: F.length(h) + F.length(g))
        ends = _let(steps, lambda y: _running(y, lambda a, b: a + b, 0))
        hits = F.zip_with(x["h"], ends, lambda h, e: F.struct(h.alias("h"), e.alias("e")))
        hits = F.filter(hits, lambda y: keep(y["h"])) if keep else hits
        return F.transform(hits, lambda y: make(y["e"] - F.length(y["h"]), y["e"], y["h"]))

    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(F.array().cast(kind))


def _span(order):
    return lambda s, e, t: F.struct(s.alias("s"), F.lit(order).alias("o"), e.alias("e"))


def base_spans(text):
    """All base spans, by start and then kind."""
    parts = [
        _found(text, ASSIGN, _span(0), SPANS, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        _found(text, ACCESS, _span(1), SPANS),
        _found(text, HEX, _span(2), SPANS),
    ]
    return F.array_sort(F.concat(*parts))


def _encoding(token):
    out = F.lit(None).cast("int")
    for i, (pattern, _, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(pattern), i).otherwise(out)
    return out


def _by_encoding(encoding, values):
    out = F.lit(values[-1])
    for i, value in list(enumerate(values))[:-1]:
        out = F.when(encoding == i, F.lit(value)).otherwise(out)
    return out


def _values(tokens):
    """``tokens``, and instead of those that fit no encoding their parts of ``LONG`` characters or more that may."""

    def parts(x, pattern):
        make = lambda s, e, t: F.struct((x["s"] + s).alias("s"), (x["s"] + e).alias("e"), t.alias("t"))
        return _found(x["t"], pattern, make, TOKENS, lambda t: F.length(t) >= LONG)

    def cut(x, inner):
        return F.when(_encoding(F.rtrim(x["t"], F.lit("="))).isNotNull(), F.array(x)).otherwise(inner(x))

    narrower = lambda x: F.array_distinct(F.concat(*[parts(x, p) for p in NARROWER]))
    values = lambda x: F.flatten(F.transform(parts(x, VALUE), lambda y: cut(y, narrower)))
    return F.flatten(F.transform(tokens, lambda x: cut(x, values)))


def _outside(tokens, base):
    """The tokens that lie in no base span: sorted among these, a token's end is beyond all ends before it."""
    one = lambda s, o, e, t: F.struct(s.alias("s"), F.lit(o).alias("o"), e.alias("e"), t.alias("t"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: one(x["s"], 0, x["e"], F.lit(""))), F.transform(tokens, lambda x: one(x["s"], 1, x["e"], x["t"]))))

    def free(x):
        ends = F.transform(x, lambda y: F.when(y["o"] == 0, y["e"]).otherwise(0))
        tops = _let(ends, lambda y: _running(y, lambda a, b: F.greatest(a, b), 0))
        marked = F.zip_with(x, tops, lambda y, top: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["t"].alias("t"), ((y["o"] == 1) & (top < y["e"])).alias("free")))
        return F.transform(F.filter(marked, lambda y: y["free"]), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["t"].alias("t")))

    return F.when(F.size(tokens) == 0, tokens).otherwise(_let(every, free))


def _coded(tokens):
    """The tokens with a known encoding, without padding: (s, e, t, c)."""
    bare = F.transform(tokens, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.rtrim(x["t"], F.lit("=")).alias("t")))
    coded = F.transform(bare, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), _encoding(x["t"]).alias("c")))
    return F.filter(coded, lambda x: x["c"].isNotNull() & (F.length(x["t"]) >= 16))


def _decoys(text, coded):
    """For each token ``DECOYS`` pieces of its document's words, as long as it and in its alphabet: (s, e, t, c).

    The words, without the document's tokens, begin with a capital and follow each other
    without blanks; in the encodings of sixteen symbols each letter stands for one. A
    document of few words has them repeated, and one of none has no decoys.
    """
    words = F.filter(F.split(F.regexp_replace(F.initcap(F.regexp_replace(text, TOKEN, " ")), "[^A-Za-z]+", " "), " "), lambda w: w != "")
    longest = F.array_max(F.transform(coded, lambda x: F.length(x["t"])))
    letters = "abcdefghijklmnopqrstuvwxyz"

    def pieces(x):
        w, many = x["w"], F.size(x["w"])
        extended = F.flatten(F.array_repeat(w, F.ceil(x["n"] / many).cast("int") + 1))

        def one(y, words, at):
            n = F.length(y["t"])
            piece = F.substring(F.array_join(F.slice(words, F.pmod(at * 7, many) + 1, n), ""), F.lit(1), n)
            sixteen = [F.translate(F.lower(piece), letters, "".join(symbols[i % 16] for i in range(26))) for _, symbols, _ in ENCODINGS[:2]]
            return F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.when(y["c"] == 0, sixteen[0]).when(y["c"] == 1, sixteen[1]).otherwise(piece).alias("t"), y["c"].alias("c"))

        def all_of(words):
            return F.flatten(F.transform(coded, lambda y, i: F.transform(F.sequence(F.lit(0), F.lit(DECOYS - 1)), lambda j: one(y, words, i * DECOYS + j))))

        return F.when(many == 0, F.filter(coded, lambda y: F.lit(False))).otherwise(_let(extended, all_of))

    made = _let(F.struct(words.alias("w"), longest.alias("n")), pieces)
    return F.when(F.size(coded) == 0, coded).otherwise(made)


def _battery(coded):
    """Structs (s, e, c, b) of tokens (s, e, t, c): class and binned p-value."""

    def symbols(x):
        alphabet = _by_encoding(x["c"], [e[1] for e in ENCODINGS])
        v = F.transform(F.split(x["t"], ""), lambda ch: F.instr(alphabet, ch).cast("double") - 1)
        k = F.length(alphabet)
        w = _by_encoding(x["c"], [e[2] for e in ENCODINGS])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["c"].alias("c"), v.alias("v"), k.alias("k"), w.alias("w"), F.size(v).cast("double").alias("n"))

    def total(array):
        return F.aggregate(array, F.lit(0.0), lambda a, y: a + y)

    def sums(x):
        v, n, mean = x["v"], x["n"], total(x["v"]) / x["n"]
        cells = (x["k"] / x["w"]).cast("int")
        squares = total(
            F.transform(F.sequence(F.lit(0), cells - 1), lambda j: F.pow(F.size(F.filter(v, lambda y: F.floor(y / x["w"]) == j)).cast("double"), F.lit(2.0)))
        )
        head, tail = F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1)
        high = F.size(F.filter(v, lambda y: y >= x["k"] / 2)).cast("double")
        turns = total(F.zip_with(head, tail, lambda a, b: F.when((a >= x["k"] / 2) != (b >= x["k"] / 2), 1.0).otherwise(0.0)))
        c0 = total(F.transform(v, lambda y: (y - mean) * (y - mean)))
        c1 = total(F.zip_with(head, tail, lambda a, b: (a - mean) * (b - mean)))
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["c"].alias("c"), n.alias("n"), cells.cast("double").alias("m"),
            squares.alias("q"), high.alias("h"), turns.alias("r"), c0.alias("c0"), c1.alias("c1"),
        )

    def tail(z):
        """Twice the upper tail of the normal distribution, closely enough for bins of half a decade."""
        return F.exp(-0.717 * z - 0.416 * z * z)

    def judged(x):
        n, m = x["n"], x["m"]
        chi = (m / n * x["q"] - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        mean = 1 + 2 * x["h"] * (n - x["h"]) / n
        runs = F.when(
            (x["h"] > 0) & (x["h"] < n) & (mean > 2), F.abs(x["r"] + 1 - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        ).otherwise(FAR)
        serial = F.when(x["c0"] > 0, F.abs(x["c1"] / x["c0"] + 1 / n) * F.sqrt(n)).otherwise(FAR)
        p = F.least(F.when(chi > 0, tail(chi) / 2).otherwise(1.0), tail(F.least(runs, F.lit(12.0))), tail(F.least(serial, F.lit(12.0)))) * 3
        size = F.least(F.floor(2 * F.log2(n)), F.lit(SIZES - 1)).cast("int")
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), (x["c"] * SIZES + size).alias("c"),
            F.least(F.floor(-2 * F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30)))).cast("int"), F.lit(LAST_BIN)).alias("b"),
        )

    return F.transform(F.transform(F.transform(coded, symbols), sums), judged)


def cutoffs(tokens, decoys, rate: float) -> dict[int, int]:
    """For each class the first bin whose tokens are not reported: Benjamini-Hochberg at ``rate``.

    Both are rows (class, bin, number). The share of decoys at least as random is the
    p-value of "no secret". A class without decoys is judged by those of the next shorter
    class of its encoding that has some, which look more random; without any it is not
    reported.
    """
    by_class: dict[int, dict[int, int]] = defaultdict(dict)
    by_decoys: dict[int, dict[int, int]] = defaultdict(dict)
    for rows, into in ((tokens, by_class), (decoys, by_decoys)):
        for c, b, n in rows:
            into[c][b] = n
    out = {}
    for c, bins in by_class.items():
        other = next((by_decoys[x] for x in range(c, c // SIZES * SIZES - 1, -1) if x in by_decoys), {})
        out[c], random, alike = 0, 0, 0
        for b in range(LAST_BIN + 1):
            random, alike = random + bins.get(b, 0), alike + other.get(b, 0)
            if random and sum(bins.values()) * (alike + 1) / (sum(other.values()) + 1) <= rate * random:
                out[c] = b + 1
    return out


def secret_scan(docs: DataFrame, keep: list[str] | None = None, rate: float = 0.05) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) and ``base``, ``spans``: arrays of (s, o, e).

    ``s`` and ``e`` count code points, ``e`` exclusive; ``o`` indexes ``KINDS``. ``spans``
    holds the base spans and the random tokens that lie in none of them; of a token that fits
    no encoding, as ``NAME=value`` or ``path/some_key``, the parts are judged. A null or empty
    text has no spans; rows that repeat are scanned alike; an empty table gives an empty
    result; columns of ``docs`` called ``base`` and ``spans`` are replaced, all others pass
    through. The work grows with a text's length but for a logarithm. The tokens' p-values
    go to a written table, the counts of tokens and of decoys by class and bin (at most 128
    classes of 61 bins, whatever the input) to the driver.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("base", "spans")]
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = _found(text, TOKEN, lambda s, e, t: F.struct(s.alias("s"), e.alias("e"), t.alias("t")), TOKENS)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    scanned = docs.select(row, F.when(F.size(tokens) > 0, text).alias("text"), base_spans(text).alias("base"), tokens.alias("runs"))
    coded = scanned.select("row", "text", "base", _coded(_outside(_values(F.col("runs")), F.col("base"))).alias("coded"))
    judged = coded.select("row", "base", _battery(F.col("coded")).alias("tokens"), _battery(_decoys(F.col("text"), F.col("coded"))).alias("decoys"))
    first = written(judged, "secrets")
    sets = [first.select(F.explode(c).alias("t")).groupBy("t.c", "t.b").count().collect() for c in ("tokens", "decoys")]
    limit = cutoffs(*[[tuple(r) for r in rows] for rows in sets], rate)

    def passes(x):
        ok = F.lit(False)
        for c, b in limit.items():
            ok = ok | ((x["c"] == c) & (x["b"] < b))
        return ok

    added = F.transform(F.filter("tokens", passes), lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("o"), x["e"].alias("e")))
    return first.select("row.*", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans):
    """``kind:start:end`` of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(kind, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text, spans, mark: str = "[SECRET]"):
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``; ``spans`` are sorted.

    Texts are taken from blocks of a fixed number of code points, so that the work grows
    with the text and not with its length times its spans.
    """
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))

    def between(x, a, b):
        """Code points ``a`` to ``b`` of the blocks ``x``."""
        first, last = F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")
        head = F.substring(F.element_at(x, first + 1), a - first * CUT + 1, b - a)
        middle = F.array_join(F.slice(x, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.substring(F.element_at(x, last + 1), F.lit(1), b - last * CUT)
        return F.when(b <= a, "").when(first == last, head).otherwise(F.concat(head, middle, tail))

    def cut(x):
        tops = _let(F.transform(spans, lambda y: y["e"]), lambda y: _running(y, lambda a, b: F.greatest(a, b), 0))

        def pieces(tops):
            before = F.concat(F.array(F.lit(0)), F.slice(tops, F.lit(1), F.size(tops) - 1))
            runs = F.filter(F.zip_with(spans, before, lambda y, top: F.struct(top.alias("a"), y["s"].alias("b"))), lambda y: y["b"] >= y["a"])
            kept = F.transform(runs, lambda y: F.concat(between(x, y["a"], y["b"]), F.lit(mark)))
            return F.concat(F.array_join(kept, ""), between(x, F.element_at(tops, -1), F.length(text)))

        return _let(tops, pieces)

    return F.when(F.size(spans) == 0, text).otherwise(_let(blocks, cut))


def query(spark, sf_dir):
    """``op4_secret_scan``: the secrets of every text of ``documents``."""
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda o: F.size(F.filter("base", lambda x: x["o"] == o)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
