"""SentencePiece encoding and decoding in batches of numpy.

A text is cut into words, which no piece crosses, and every word is encoded once. Words of
equal length advance together: hashes of all their substrings probe the sorted hashes of
the pieces, and then either vectorised maxima find the path of the largest total score and
store its backpointers (Viterbi, what a unigram model asks for), or vectorised maxima pick
the pair to merge next (what a byte-pair model asks for). A very long word is cut where no piece
of it lies on both sides, in windows; what is left of it in one is walked in windows too.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import table

BLANK = "▁"
UNIGRAM, PAIRS = 1, 2
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept with their ids by each Python worker.
CACHED = 600_000
#: Words longer than this are merged one by one, with a heap.
LONG = 96
#: Characters of a longer word that are probed at once.
WINDOW = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of the fields of a protocol buffer."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, kind, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, kind, data[at : at + n]
            at += n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _scan(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PieceModel:
    """The pieces of a model file, and how its texts are made ready."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        spec, normal = {}, {}
        for number, _, value in fields(data):
            if number == 1:
                f = {n: v for n, _, v in fields(value)}
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                spec = {n: v for n, _, v in fields(value)}
            elif number == 3:
                normal = {n: v for n, _, v in fields(value)}
        self.type = spec.get(3, UNIGRAM)
        self.prefix, self.squeeze, self.escape = normal.get(3, 1), normal.get(4, 1), normal.get(5, 1)
        whole = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        if normal.get(2) or self.squeeze or not self.escape or self.type not in (UNIGRAM, PAIRS) or {DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only models that keep texts as they are, without user-defined or unused pieces, are supported")
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in whole):
            raise ValueError("a piece holds a blank after another character")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.longest = max(len(self.pieces[i]) for i in whole)
        keys = {}
        for i in whole:
            codes = np.array([ord(c) + 1 for c in self.pieces[i]], np.uint64)
            keys[int(_mixed((codes * _scan(_BASE, len(codes))).sum(keepdims=True))[0])] = i
        if len(keys) != len(whole):
            raise ValueError("two pieces share a hash")
        # Sorted hashes and ids of the pieces of each length.
        self.keys = {}
        for n in range(1, self.longest + 1):
            own = sorted(k for k, i in keys.items() if len(self.pieces[i]) == n)
            if own:
                self.keys[n] = np.array(own, np.uint64), np.array([keys[k] for k in own], np.int32)
        #: Ids of single ASCII characters that are no pieces, by their bytes; -1 without such ids.
        self.ascii = np.array([self.bytes.get(b, -1) for b in range(128)], np.int32)
        self.values = np.array(self.scores)
        self.by_text = {self.pieces[i]: i for i in whole}
        order = {x: i for i, x in enumerate(sorted({self.scores[i] for i in whole}, reverse=True))}
        #: Place of each piece among all by score, the largest first; equal scores share one.
        self.order = {p: order[self.scores[i]] for p, i in self.by_text.items()}
        self.cut = (_RUN if all(_RUN.fullmatch(p) for p in self.by_text) else _WORD).findall
        self.worst = min(self.values[whole]) - 10

    def ready(self, text: str) -> str:
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """Ids of the pieces [word, start, length - 1]; -1 where a substring is none."""
        n, size = codes.shape
        most = min(self.longest, size)
        power, inverse = _scan(_BASE, size), _scan(_INVERSE, size)
        prefix = np.zeros((n, size + 1), np.uint64)
        np.cumsum((codes + np.uint64(1)) * power, axis=1, out=prefix[:, 1:])
        out = np.full((n, size, most), -1, np.int32)
        for length in range(1, most + 1):
            if length not in self.keys:
                continue
            keys, ids = self.keys[length]
            starts = size - length + 1
            key = _mixed((prefix[:, length:] - prefix[:, :starts]) * inverse[:starts])
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            out[:, :starts, length - 1] = np.where(keys[at] == key, ids[at], -1)
        return out

    def viterbi(self, found: np.ndarray) -> np.ndarray:
        """Lengths of the pieces of the best path by their starts, 0 elsewhere; ties go to the longer piece."""
        n, size, most = found.shape
        score = np.where(found >= 0, self.values[found], -np.inf)
        score[:, :, 0] = np.where(found[:, :, 0] >= 0, score[:, :, 0], self.worst)
        best = np.zeros((n, size + 1))
        back = np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            lengths = np.arange(min(most, end), 0, -1)
            options = best[:, end - lengths] + score[:, end - lengths, lengths - 1]
            pick = options.argmax(1)
            best[:, end] = options[np.arange(n), pick]
            back[:, end] = lengths[pick]
        out = np.zeros((n, size), np.int32)
        rows, end = np.arange(n), np.full(n, size)
        while len(rows):
            length = back[rows, end]
            end = end - length
            out[rows, end] = length
            rows, end = rows[end > 0], end[end > 0]
        return out

    def merged(self, found: np.ndarray) -> np.ndarray:
        """Lengths of the pieces left when the best adjacent pair, leftmost of equals, is merged again and again."""
        n, size, most = found.shape
        score = np.where(found >= 0, self.values[found], -np.inf)
        lengths = np.ones((n, size), np.int32)
        rows = np.arange(n)
        places = np.arange(size)
        while len(rows):
            own = lengths[rows]
            after = places + own
            beyond = np.where((own > 0) & (after < size), np.take_along_axis(own, np.minimum(after, size - 1), 1), 0)
            both = own + beyond
            can = (beyond > 0) & (both <= most)
            value = np.where(can, score[rows[:, None], places, np.clip(both - 1, 0, most - 1)], -np.inf)
            pick = value.argmax(1)
            some = np.flatnonzero(value[np.arange(len(rows)), pick] > -np.inf)
            rows, pick = rows[some], pick[some]
            lengths[rows, pick + own[some, pick]] = 0
            lengths[rows, pick] = both[some, pick]
        return lengths

    def merged_long(self, word: str) -> array:
        """Lengths of the pieces of one long word, by a heap of pairs: numbers of score, place and length, in this order."""
        n = len(word)
        size, before, after = array("i", [1]) * n, array("i", range(-1, n - 1)), array("i", range(1, n + 1))
        heap: list[int] = []

        def offered(i):
            j = after[i]
            if j < n and size[i] + size[j] <= self.longest:
                order = self.order.get(word[i : i + size[i] + size[j]])
                if order is not None:
                    return order << 48 | i << 12 | size[i] + size[j]
            return -1

        heap = [x for x in map(offered, range(n - 1)) if x >= 0]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i, length = x >> 12 & (1 << 36) - 1, x & 4095
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != length:
                continue
            size[i], size[j] = length, 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (x := offered(k)) >= 0:
                    heapq.heappush(heap, x)
        return size

    def windows(self, word: str) -> Iterator[tuple[int, np.ndarray]]:
        """Starts of windows of a long word, and the ids of the pieces [start, length - 1] from each place of theirs."""
        for at in range(0, len(word), WINDOW):
            part = word[at : at + WINDOW + self.longest - 1]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            yield at, self.probe(codes[None, :])[0, :WINDOW]

    def parts(self, word: str) -> Iterator[str]:
        """A long word cut wherever no piece of it lies on both sides: neither segmentation crosses there."""
        start, reach = 0, 0
        for at, found in self.windows(word):
            some = found >= 0
            ends = np.arange(len(found)) + np.where(some.any(1), some.shape[1] - some[:, ::-1].argmax(1), 1)
            ends = np.maximum.accumulate(np.maximum(ends + at, reach))
            places = np.arange(at, at + len(found))
            free = places[np.concatenate([[reach], ends[:-1]]) <= places]
            for cut in free[free > start].tolist():
                yield word[start:cut]
                start = cut
            reach = int(ends[-1])
        yield word[start:]

    def viterbi_long(self, word: str) -> np.ndarray:
        """Lengths of the pieces of the best path of one long word by their starts, 0 elsewhere; ties go to the longer piece."""
        n, most = len(word), self.longest
        back = np.zeros(n + 1, np.uint16)
        ahead = np.full(WINDOW + most, -np.inf)  # best scores from the window's start on
        ahead[0] = 0.0
        for at, found in self.windows(word):
            if at:
                ahead[: most] = ahead[WINDOW:].copy()
                ahead[most:] = -np.inf
            score = np.where(found >= 0, self.values[found], -np.inf)
            score[:, 0] = np.where(found[:, 0] >= 0, score[:, 0], self.worst)
            for i in range(len(found)):
                to = ahead[i + 1 : i + 1 + score.shape[1]]
                option = ahead[i] + score[i]
                better = np.flatnonzero(option > to)
                to[better] = option[better]
                back[at + i + 1 + better] = better + 1
        out = np.zeros(n, np.uint16)
        end = n
        while end:
            length = int(back[end])
            end -= length
            out[end] = length
        return out

    def long_word(self, word: str) -> tuple[bytes, bytes]:
        """Both encodings of a word that is cut first, if it can be."""
        own, best, waiting = [], [], []

        def settle():
            short = self.words(list({w for w in waiting if len(w) <= WINDOW}))
            for w in waiting:
                if len(w) <= WINDOW:
                    a, b = short[w]
                else:
                    b = self._slow_ids(w, self.viterbi_long(w))
                    a = b if self.type == UNIGRAM else self._slow_ids(w, self.merged_long(w))
                own.append(a)
                best.append(b)
            waiting.clear()

        # Without ids for single bytes a run of unknown characters is one id, which a cut would double.
        for part in self.parts(word) if self.bytes else [word]:
            waiting.append(part)
            if len(waiting) >= WINDOW:
                settle()
        settle()
        return b"".join(own), b"".join(best)

    def _slow_ids(self, word: str, lengths) -> bytes:
        """Ids of a word with characters that are no pieces: bytes, or one unknown for each run of them."""
        out, at, lost = array("I"), 0, False
        while at < len(word):
            piece = word[at : at + int(lengths[at])]
            i = self.by_text.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            elif not lost:
                out.append(self.unknown)
            lost = i is None
            at += len(piece)
        return np.frombuffer(out, np.uint32).astype("<u4").tobytes()

    def _ids(self, words: list[str], codes: np.ndarray, found: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        row, start = np.nonzero(lengths)
        ids = found[row, start, np.minimum(lengths[row, start], found.shape[2]) - 1]
        lost = np.flatnonzero(ids < 0)
        code = codes[row[lost], start[lost]]
        ids[lost] = np.where(code < 128, self.ascii[np.minimum(code, 127).astype(np.int64)], -1)
        flat = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(row, minlength=len(words)))).tolist()
        out = [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.unique(row[ids < 0]).tolist():
            out[i] = self._slow_ids(words[i], lengths[i])
        return out

    def words(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """For each word its ids as its model has them, and those of the best path."""
        out = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for size, some in by_length.items():
            if size > WINDOW:
                out.update((w, self.long_word(w)) for w in some)
                continue
            step = max(1, (1 << 18) // (size * min(size, self.longest)))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size).astype(np.uint64)
                found = self.probe(codes)
                best = self._ids(part, codes, found, self.viterbi(found))
                if self.type == UNIGRAM:
                    own = best
                elif size <= LONG:
                    own = self._ids(part, codes, found, self.merged(found))
                else:
                    own = self._ids(part, codes, found, np.stack([np.frombuffer(self.merged_long(w), np.int32) for w in part]))
                out.update(zip(part, zip(own, best, strict=True), strict=True))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; unknown ones show as a question mark in a diamond."""
        if not hasattr(self, "shown"):
            self.shown = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b"\xef\xbf\xbd" if k == UNKNOWN else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        text = b"".join(map(self.shown.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Finer, where no piece holds both a letter and another sign; raised digits and fractions are signs.
_SIGNS = "\\d_\u00b2\u00b3\u00b9\u00bc-\u00be"
_RUN = re.compile(rf"{BLANK}*(?:[^\W{_SIGNS}]+|(?:[^\w{BLANK}]|[{_SIGNS}])+)|{BLANK}+")


class Encoder:
    """A model with the words it has met; read from its file by each worker."""

    def __init__(self, path: str):
        self.path, self.model, self.known = path, None, {}

    def __reduce__(self):
        return Encoder, (self.path,)

    def load(self) -> PieceModel:
        if self.model is None:
            with open(self.path, "rb") as f:
                self.model = PieceModel(f.read())
        return self.model

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text as its model has them, and those of the best path."""
        model = self.load()
        out = []
        for at in range(0, len(texts), 200):
            cut = [model.cut(model.ready(t)) for t in texts[at : at + 200]]
            words = set().union(*cut)
            new = [w for w in words if w not in self.known]
            if len(self.known) + len(new) > CACHED:
                self.known.clear()
                new = list(words)
            self.known.update(model.words(new))
            for c in cut:
                own, best = zip(*map(self.known.__getitem__, c)) if c else ((), ())
                out.append((np.frombuffer(b"".join(own), "<u4"), np.frombuffer(b"".join(best), "<u4")))
        return out


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` and ``best_ids`` (arrays of int) of the whole ``text``.

    ``ids`` are those the model's own kind of segmentation gives, equal to its library's;
    ``best_ids`` are those of the largest total score. For a unigram model they are the
    same. A null or empty text has none. Repeated rows are encoded alike; columns of these
    names are replaced, all others pass through.
    """
    tool = Encoder(path)

    @F.pandas_udf("ids array<int>, best_ids array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(tool.encode([t or "" for t in texts]), columns=["ids", "best_ids"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "best_ids")]
    return docs.select(*kept, run(F.col("text")).alias("__ids")).select(*kept, "__ids.*")


def decoded(path: str):
    """A function from a column of id arrays to the texts they stand for; null stays null."""
    tool = Encoder(path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            model = tool.load()
            yield pd.Series([None if r is None else model.decode(r) for r in rows], dtype=object)

    return run


def summaries(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_best, best_crc32, n_ids, ids_crc32, round_trip)``: both encodings without their ids.

    The best path's come first, then those of the model's own kind of segmentation. ``round_trip`` tells whether both decode to the text (a null one counts as empty); it
    is false for texts that hold the blank's own sign.
    """
    tool = Encoder(path)

    @F.pandas_udf("n_ids long, ids_crc32 long, n_best long, best_crc32 long, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            texts = [t or "" for t in texts]
            for at in range(0, len(texts), 500):
                for t, (a, b) in zip(texts[at : at + 500], tool.encode(texts[at : at + 500]), strict=True):
                    same = tool.model.decode(a) == t and tool.model.decode(b) == t
                    rows.append((len(a), zlib.crc32(a.tobytes()), len(b), zlib.crc32(b.tobytes()), same))
            yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "n_best", "best_crc32", "round_trip"])

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.n_best", "r.best_crc32", "r.n_ids", "r.ids_crc32", "r.round_trip")


def query(spark, sf_dir):
    """``op3_pieces``: every text of ``documents`` encoded with the public 32k vocabulary, and decoded."""
    from public_tokenizers import path

    return summaries(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))
