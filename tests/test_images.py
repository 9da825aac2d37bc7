import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.engine import Engine, Options
from gleaner.functions import images as I
from gleaner.operators import similar


def noise(seed, n=128):
    """A smooth random picture, so that small changes stay small."""
    rng = np.random.default_rng(seed)
    small = rng.integers(0, 256, (8, 8, 3)).astype(float)
    grow = I._weights(8, n)
    return np.clip(np.stack([grow @ small[:, :, c] @ grow.T for c in range(3)], axis=2), 0, 255).astype(np.uint8)


def png(pixels):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[i, :, ::-1].tobytes() for i in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def least(a, b):
    return min(I._apart(x, y) for x in a for y in b[:1])


def test_variants_match_by_mode():
    a = noise(1)
    assert (len(I.blocks(a, "off")), len(I.blocks(a, "mirror"))) == (1, 3)
    full = I.blocks(a, "full")
    assert 8 <= len(full) <= 11
    for other in (a[:, ::-1], a[::-1], np.rot90(a), np.rot90(a, 2), np.rot90(a[:, ::-1])):
        assert least(full, I.blocks(np.ascontiguousarray(other), "off")) <= 4
    assert least(I.blocks(a, "mirror"), I.blocks(a[:, ::-1], "off")) <= 4
    assert least(full, I.blocks(noise(2), "off")) > 10
    assert I.blocks(np.full((64, 64, 3), 7, np.uint8)) == []


def test_orientations_undo_each_other():
    a = noise(3, 40)[:, :30]
    assert all(I.upright(a, o).shape[:2] == ((30, 40) if o >= 5 else (40, 30)) for o in range(1, 9))
    assert np.array_equal(I.upright(I.upright(a, 6), 8), a) and np.array_equal(I.upright(I.upright(a, 5), 5), a)
    assert I.rotated(a, 0.0).shape == a.shape and np.array_equal(I.rotated(a, 0.0), a)


def jpeg(*parts):
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b for m, b in parts) + b"\xff\xda\0\2\xff\xd9"


def exif_part(order=">"):
    texts = [(0x010F, b"Maker\0"), (0x0110, b"Model X\0"), (0x0132, b"2020:01:02 03:04:05\0")]
    at = 8 + 2 + 12 * (len(texts) + 1) + 4
    entries, data = b"", b""
    for tag, text in texts:
        entries += struct.pack(order + "HHII", tag, 2, len(text), at + len(data))
        data += text
    entries += struct.pack(order + "HHIHH", 0x0112, 3, 1, 6, 0)
    head = b"MM" if order == ">" else b"II"
    return b"Exif\0\0" + head + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(texts) + 1) + entries + struct.pack(order + "I", 0) + data


@pytest.mark.parametrize("order", [">", "<"])
def test_exif(order):
    found = I.exif(jpeg((0xE1, exif_part(order))))
    assert found == {"make": "Maker", "model": "Model X", "date_time": "2020:01:02 03:04:05", "orientation": 6}
    assert I.exif(b"") == {} and I.exif(jpeg((0xE1, b"Exif\0\0XX"))) == {}


def quantised(table):
    return bytes([0]) + bytes(table[place] for place in I.zigzag())


def test_jpeg_facts(spark):
    coarse, camera, odd = I.table_of_quality(75), I.table_of_quality(97), [40] * 64
    assert I.luma_table(jpeg((0xDB, quantised(coarse)))) == coarse
    files = {
        "a.jpg": jpeg((0xDB, quantised(coarse))), "b.jpg": jpeg((0xDB, quantised(camera)), (0xE1, exif_part())), "c.jpg": jpeg((0xDB, quantised(odd)))[:-2],
        "d.jpg": jpeg((0xE1, I.XMP + b"<x xmpMM:History/>")), "e.jpg": b"", "f.txt": b"not a picture",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: r for r in I.facts(df).collect()}
    assert {k: r.compressed_twice for k, r in got.items()} == {"a.jpg": True, "b.jpg": False, "c.jpg": True, "d.jpg": False, "e.jpg": False, "f.txt": False}
    assert {k for k, r in got.items() if r.truncated} == {"c.jpg", "e.jpg"}
    assert got["d.jpg"].history and got["b.jpg"].model == "Model X" and got["b.jpg"].orientation == 6
    scores = I.facts(df).select("path", I.exif_part(F.lit(0)).alias("e"), I.name_part(F.lit("/x/IMG_1234.jpg")).alias("n"), I.path_part(F.lit("/home/u/tmp/x")).alias("p")).collect()
    by = {r.path: r for r in scores}
    assert by["b.jpg"].e == 20 and by["a.jpg"].e == -35 and by["d.jpg"].e == -40 and by["a.jpg"].p == -30
    assert by["a.jpg"].n == 25


def test_fingerprints_of_files(spark, tmp_path):
    a = noise(5)
    for name, pixels in (("a", a), ("b", np.clip(a.astype(int) + 2, 0, 255).astype(np.uint8)), ("c", noise(6)), ("plain", np.full((32, 32, 3), 9, np.uint8))):
        (tmp_path / f"{name}.png").write_bytes(png(pixels))
    got = {r.path.rpartition("/")[2]: r for r in I.fingerprints(spark.read.format("image").load(str(tmp_path)), "mirror").collect()}
    block = lambda n: [(x.p, x.d) for x in got[n].blocks]
    assert block("a.png") == I.blocks(a, "mirror") and got["a.png"].min_side == 128
    assert least(block("a.png"), block("b.png")) <= 4 < 10 < least(block("a.png"), block("c.png"))
    assert got["plain.png"].blocks is None and got["plain.png"].error == "degenerate hash"


def test_preview_of_a_raw_file():
    frame = lambda w, h: (0xC0, bytes([8]) + struct.pack(">HH", h, w) + b"\1\1\x11\0")
    small, middle, large = (jpeg(frame(*x)) for x in ((160, 120), (400, 300), (1600, 1200)))
    assert I.dimensions(large) == (1600, 1200) and I.dimensions(b"none") is None
    assert I.preview(b"RAW" + small + b"xx" + large + b"yy" + middle + b"end") == large
    assert I.preview(b"RAW" + small) is None and I.preview(b"") is None


def test_variants_and_sizes_decide_groups(spark):
    a, b, c = noise(21, 600), noise(22, 600), noise(23, 600)
    h = 600
    pictures = {
        "a": a, "a-flipped": a[:, ::-1], "a-upside": a[::-1], "b": b, "b-turned": np.rot90(b), "b-half": np.rot90(b, 2),
        "c": c, "c-cropped": c[h // 10 : h // 10 + h * 8 // 10, h // 10 : h // 10 + h * 8 // 10], "lone": noise(24, 600),
    }
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    df = spark.createDataFrame([((k, x.shape[0], x.shape[1], 3, 16, bytearray(np.ascontiguousarray(x).tobytes())),) for k, x in pictures.items()], schema)

    def groups(mode):
        out = {}
        for r in Engine(spark.createDataFrame([], "path string, kind string"), Options(excludes=())).similar(df, mode).collect():
            out.setdefault(r.group_id, set()).add(r.id)
        return sorted(map(sorted, out.values()))

    assert groups("off") == []
    assert groups("mirror") == [["a", "a-flipped", "a-upside"]]
    assert groups("full") == [["a", "a-flipped", "a-upside"], ["b", "b-half", "b-turned"], ["c", "c-cropped"]]


def test_pairs_with_variants_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: int(rng.integers(-(1 << 63), (1 << 63) - 1))
    flip = lambda w, n: int(np.bitwise_xor.reduce([np.int64(w)] + [np.int64(1) << np.int64(i) for i in rng.choice(63, n, replace=False)]))
    rows = []
    for i in range(0, 80, 2):
        blocks = [(word(), word()) for _ in range(3)]
        near = (flip(blocks[i % 3][0], int(rng.integers(0, 7))), flip(blocks[i % 3][1], int(rng.integers(0, 6))))
        rows += [(i, *blocks[0], blocks, int(rng.choice([4, 6, 8, 10]))), (i + 1, *near, [near, (word(), word())], 10)]
    df = spark.createDataFrame(rows, "id long, p long, d long, blocks array<struct<p:long,d:long>>, within int")
    want = set()
    for x in rows:
        for y in rows:
            apart = min([I._apart(v, y[3][0]) for v in x[3]] + [I._apart(x[3][0], v) for v in y[3]])
            if x[0] < y[0] and np.ceil(apart) <= min(x[4], y[4]):
                want.add((x[0], y[0], int(np.ceil(apart))))
    got = {(r.a, r.b, r.distance) for r in similar.near_pairs(similar.classes(df)).collect()}
    assert len(want) > 10 and got == want
