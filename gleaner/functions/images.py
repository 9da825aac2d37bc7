"""Images: perceptual fingerprints, and what JPEG files tell about their past.

Pixels come from Spark's ``image`` source, bytes from ``binaryFile``; only these functions
run in Python, in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dictionaries as D
from gleaner.functions import paths

LOW, HIGH = 10, 54
#: Digits of brightness that count: well above what rounding errors reach.
DIGITS = 6
MODES = ("off", "mirror", "full")


def _weights(n: int, m: int) -> np.ndarray:
    """Rows that average ``n`` pixels down, or spread them out, to ``m``."""
    edges = np.linspace(0, n, m + 1)
    out = np.zeros((m, n))
    for i in range(m):
        a, b = edges[i], edges[i + 1]
        for j in range(int(a), min(n, int(np.ceil(b)))):
            out[i, j] = min(b, j + 1) - max(a, j)
    return out / out.sum(1, keepdims=True)


def shrunk(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    return _weights(gray.shape[0], height) @ gray @ _weights(gray.shape[1], width).T


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def _packed(bits: np.ndarray) -> int:
    """64 bits, row by row, as a signed number."""
    return int(np.packbits(bits.reshape(-1)).view(">i8")[0])


def p_hash(gray: np.ndarray) -> int:
    """Low frequencies above their median; rounded, so that a plain image has no bits of rounding errors."""
    c = _cosines(32)
    low = np.round((c @ shrunk(gray, 32, 32) @ c.T)[:8, :8], DIGITS)
    return _packed(low > np.median(low))


def d_hash(gray: np.ndarray) -> int:
    """Whether brightness falls from each cell to the next one of its row."""
    small = np.round(shrunk(gray, 8, 9), DIGITS)
    return _packed(small[:, :-1] > small[:, 1:])


def gray_of(pixels: np.ndarray) -> np.ndarray:
    """Brightness of rows of BGR(A) or grey pixels."""
    x = pixels.astype(np.float64)
    return x[:, :, 0] if x.shape[2] == 1 else 0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2]


def rotated(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation on a canvas that grows, white around it, with bilinear samples."""
    h, w = pixels.shape[:2]
    angle = np.deg2rad(degrees)
    cos, sin = np.cos(angle), np.sin(angle)
    width, height = int(np.ceil(w * abs(cos) + h * abs(sin))), int(np.ceil(w * abs(sin) + h * abs(cos)))
    dx, dy = np.meshgrid(np.arange(width) + 0.5 - width / 2, np.arange(height) + 0.5 - height / 2)
    sx, sy = cos * dx + sin * dy + w / 2 - 0.5, cos * dy - sin * dx + h / 2 - 0.5
    inside = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1)
    x0, y0 = np.clip(np.floor(sx).astype(int), 0, w - 1), np.clip(np.floor(sy).astype(int), 0, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (sx - x0)[:, :, None], (sy - y0)[:, :, None]
    mixed = (pixels[y0, x0] * (1 - fx) + pixels[y0, x1] * fx) * (1 - fy) + (pixels[y1, x0] * (1 - fx) + pixels[y1, x1] * fx) * fy
    return np.where(inside[:, :, None], np.rint(mixed), 255).astype(np.uint8)


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned as the container's orientation (1 to 8) asks; quarter turns are clockwise."""
    turn = lambda x, n: np.rot90(x, -n)
    return {
        2: lambda x: x[:, ::-1], 3: lambda x: turn(x, 2), 4: lambda x: x[::-1], 5: lambda x: turn(x[:, ::-1], 1), 6: lambda x: turn(x, 1),
        7: lambda x: turn(x[:, ::-1], 3), 8: lambda x: turn(x, 3),
    }.get(orientation, lambda x: x)(pixels)


def _block(pixels) -> tuple[int, int]:
    gray = gray_of(pixels)
    return p_hash(gray), d_hash(gray)


def _count(x: int) -> int:
    return (x & (1 << 64) - 1).bit_count()


def _varied(block) -> bool:
    return all(LOW <= _count(w) <= HIGH for w in block)


def _apart(a, b) -> float:
    return _count(a[0] ^ b[0]) + 0.7 * _count(a[1] ^ b[1])


def blocks(pixels: np.ndarray, mode: str = "mirror") -> list[tuple[int, int]]:
    """The image's own block, then those of its variants that are not within 1.0 of one before.

    ``mirror`` adds both flips, ``full`` all eight alignments, the middle four fifths and
    rotations by three degrees. Empty if the image is too plain to tell.
    """
    first = _block(pixels)
    if not _varied(first):
        return []
    flipped = pixels[:, ::-1]
    variants = [] if mode == "off" else [(flipped, False), (pixels[::-1], False)]
    if mode == "full":
        variants += [(np.rot90(pixels, -n), False) for n in (1, 2, 3)] + [(np.rot90(flipped, -n), False) for n in (1, 3)]
        step = max(1, -(-max(pixels.shape[:2]) // 1024))
        small = pixels[::step, ::step]
        h, w = small.shape[:2]
        variants.append((small[h // 10 : h // 10 + h * 8 // 10, w // 10 : w // 10 + w * 8 // 10], True))
        variants += [(rotated(small, a), True) for a in (3.0, -3.0)]
    out = [first]
    for image, gated in variants:
        block = _block(image)
        if (not gated or _varied(block)) and all(_apart(kept, block) > 1.0 for kept in out):
            out.append(block)
    return out


def fingerprints(images: DataFrame, mode: str = "mirror") -> DataFrame:
    """``(path, blocks, min_side, error)`` of rows of Spark's ``image`` source.

    Failures are rows too, with ``error`` and null blocks, so that they can be cached.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")

    @F.pandas_udf("blocks array<struct<p:bigint,d:bigint>>, error string")
    def run(heights: pd.Series, widths: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for h, w, c, raw in zip(heights, widths, channels, data, strict=True):
            if raw is None or h <= 0 or w <= 0 or len(raw) != h * w * c:
                out.append((None, "can't be decoded"))
                continue
            found = blocks(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), int(c)), mode)
            out.append((found, None) if found else (None, "degenerate hash"))
        return pd.DataFrame(out, columns=["blocks", "error"])

    made = run("image.height", "image.width", "image.nChannels", "image.data")
    side = F.least("image.height", "image.width")
    return images.select(F.col("image.origin").alias("path"), made.alias("m"), side.alias("min_side")).select("path", "m.blocks", "min_side", "m.error")


# Bytes of JPEG files.


def truncated(path, content):
    """Whether a JPEG doesn't end with its end marker."""
    ends = F.substring(content, -2, 2) == F.lit(b"\xff\xd9")
    return paths.lower_extension(path).isin("jpg", "jpeg") & ((F.octet_length(content) < 2) | ~ends)


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of the header's segments, up to the scan."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return
    while at + 3 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xDA:
            return
        if marker == 0 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if at + 2 + n > len(data):
            return
        yield marker, data[at + 4 : at + 2 + n]
        at += 2 + n


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a JPEG's frame header, without decoding it."""
    for marker, body in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            return int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
    return None


def preview(data: bytes, least: int = 256) -> bytes | None:
    """The largest JPEG inside a raw file whose shorter side has at least ``least`` pixels."""
    best, at = None, data.find(b"\xff\xd8\xff")
    while at >= 0:
        size = dimensions(data[at:])
        if size and min(size) >= least:
            end = data.find(b"\xff\xd9", at)
            following = data.find(b"\xff\xd8\xff", at + 3)
            while 0 <= end and 0 <= following < end:  # a thumbnail inside its header
                end, following = data.find(b"\xff\xd9", end + 2), data.find(b"\xff\xd8\xff", end + 2)
            if end >= 0 and (best is None or size[0] * size[1] > best[0]):
                best = size[0] * size[1], data[at : end + 2]
        at = data.find(b"\xff\xd8\xff", at + 3)
    return best and best[1]


def zigzag() -> list[int]:
    """Places of an 8 x 8 block in the order of its diagonals."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return [r * 8 + c for r, c in sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))]


def luma_table(data: bytes) -> list[int] | None:
    """The 8-bit quantisation table 0, row by row."""
    order = zigzag()
    for marker, body in segments(data):
        at = 0
        while marker == 0xDB and at + 65 <= len(body):
            wide, number = body[at] >> 4, body[at] & 15
            size = 128 if wide else 64
            if at + 1 + size > len(body):
                break
            if not wide and number == 0:
                out = [0] * 64
                for i, place in enumerate(order):
                    out[place] = body[at + 1 + i]
                return out
            at += 1 + size
    return None


#: Fixed values. The luminance table of the JPEG standard's annex, row by row.
STANDARD = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def table_of_quality(quality: int) -> list[int]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (x * scale + 50) // 100)) for x in STANDARD]


def table_distance(a, b):
    """Mean difference of two tables; columns or lists."""
    if isinstance(a, list):
        return sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 64
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / 64


def compressed_twice(table, coarse=None, fine=None):
    """Whether a table (an array column) is that of software rather than of a camera; false if unknown.

    ``coarse`` and ``fine`` are lists of known tables: by default those of the usual
    software qualities of 70 to 80, and of 95 and more.
    """
    coarse = [table_of_quality(q) for q in (70, 75, 80)] if coarse is None else coarse
    fine = [table_of_quality(q) for q in (95, 98)] if fine is None else fine
    lit = lambda t: F.array(*[F.lit(x) for x in t])
    near = lambda tables, d: reduce(lambda a, b: a | b, [table_distance(table, lit(t)) < d for t in tables], F.lit(False))
    mean = F.aggregate(table, F.lit(0.0), lambda s, x: s + x) / 64
    high = F.size(F.filter(table, lambda x: x > 20))
    return F.coalesce(F.when(near(coarse, 3.0), True).when(near(fine, 5.0), False).otherwise((mean > 12) & (high > 10)), F.lit(False))


XMP = b"http://ns.adobe.com/xap/1.0/\0"


def has_history(data: bytes) -> bool:
    """Whether the first XMP packet tells of edits."""
    for marker, body in segments(data):
        if marker == 0xE1 and XMP in body:
            return any(x in body for x in (b"xmpMM:History", b"stEvt:action", b"xmp:MetadataDate"))
    return False


#: Fixed values. Tags of EXIF directories.
TAGS = {
    0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0131: "software", 0x0132: "date_time", 0x9003: "date_time_original",
    0x927C: "maker_note", 0xA001: "color_space", 0x0002: "gps_latitude", 0x0004: "gps_longitude",
}
_DIRECTORIES = (0x8769, 0x8825)
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(data: bytes) -> dict:
    """Fields of ``TAGS`` in a JPEG's EXIF segment; texts, numbers, or True for what is only there."""
    for marker, body in segments(data):
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            return _directory(body[6:])
    return {}


def _directory(tiff: bytes) -> dict:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    out: dict = {}
    if order is None or len(tiff) < 8:
        return out
    todo, seen = [struct.unpack_from(order + "I", tiff, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(tiff):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, entry)
            size = _SIZES.get(kind, 0) * n
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            if tag in _DIRECTORIES:
                todo.append(struct.unpack_from(order + "I", tiff, entry + 8)[0])
            elif tag in TAGS and place + size <= len(tiff):
                raw = tiff[place : place + size]
                if kind == 2:
                    out[TAGS[tag]] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
                elif kind in (3, 4):
                    out[TAGS[tag]] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
                else:
                    out[TAGS[tag]] = True
    return out


_FACTS = "orientation int, make string, model string, software string, date_time string, date_time_original string, maker_note boolean, gps boolean, color_space boolean, any_exif boolean, history boolean, luma array<int>"


def facts(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with what JPEG headers tell, ``truncated`` and ``compressed_twice``."""

    @F.pandas_udf(_FACTS)
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            data = bytes(data or b"")
            e = exif(data)
            rows.append((
                e.get("orientation", 1), e.get("make"), e.get("model"), e.get("software"), e.get("date_time"), e.get("date_time_original"),
                "maker_note" in e, "gps_latitude" in e, "color_space" in e, bool(e), has_history(data), luma_table(data),
            ))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _FACTS.split(", ")])

    known = files.withColumn("__f", run("content")).select("*", "__f.*").drop("__f")
    return known.withColumns({"truncated": truncated(F.col("path"), F.col("content")), "compressed_twice": compressed_twice(F.col("luma"))})


#: Fixed values. File names of cameras, messengers and copies; names of editors.
CAMERA_NAMES = ("img_", "dsc_", "dscf", "pxl_", "_mg_", "gopr", "gh01", "dji_")
COPIED_NAMES = ("copy", "copia", "kopie", "(1)", "(2)", "(3)", "backup", "respaldo", "duplicate", "duplicado", "_edit", "_final", "_v2", "_v3", "-edit", "-final", "-v2")
PLAIN_NAMES = ("image.jpg", "photo.jpg", "download.jpg", "untitled", "output.jpg", "unnamed")
EDITORS = ("photoshop", "lightroom", "instagram", "whatsapp", "snapseed", "vsco", "gimp", "canva", "snapchat", "telegram", "pixelmator", "affinity", "picasa", "express")
ROUND_SIZES = ((1920, 1080), (1280, 720), (2048, 1024), (640, 480))
CAPS = {"content": 50.0, "exif": 60.0, "filename": 40.0, "path": 30.0, "fs": 20.0}


def _sum(*rules):
    return reduce(lambda a, b: a + b, [F.when(c, float(w)).otherwise(0.0) for c, w in rules])


def _capped(score, part: str):
    return F.greatest(F.lit(-CAPS[part]), F.least(F.lit(CAPS[part]), score))


def name_part(path):
    """Score of a file name: cameras' up; messengers', copies' and generic ones down."""
    name = F.lower(paths.file_name(path))
    starts = lambda *xs: reduce(lambda a, b: a | b, [F.startswith(name, F.lit(x)) for x in xs])
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digits = F.length(F.regexp_replace(stem, "[^0-9]", "")) / F.greatest(F.octet_length(stem), F.lit(1))
    score = _sum(
        (starts(*CAMERA_NAMES), 25), ((F.octet_length(name) > 20) & starts("img-") & F.contains(name, F.lit("-wa")), -30), (name.rlike("^received_[0-9]+$"), -25),
        (starts("fb_img_"), -25), (starts("snapchat-"), -25), (starts("photo_") & F.contains(name, F.lit("@")), -20),
        (reduce(lambda a, b: a | b, [F.contains(name, F.lit(x)) for x in COPIED_NAMES]), -20), (name.isin(*PLAIN_NAMES), -15), (starts("screenshot", "captura"), -10), (digits > 0.6, -5),
    )
    return _capped(score, "filename")


def path_part(path):
    """Every canonical and junk pattern the path holds, as it is written; one that several systems list counts for each."""
    canonical = [(F.contains(path, F.lit(p)), w * D.CANONICAL_TIMES.get(p, 1)) for p, w in D.CANONICAL]
    return _capped(_sum(*canonical, *[(F.contains(path, F.lit(p)), w) for p, w in D.JUNK]), "path")


def content_part(path, width, height, size, is_truncated, most_pixels=None, most_density=None):
    """Score of format, resolution and density; relative to the largest of a cluster where these are given."""
    pixels = (width * height).cast("double")
    density = size / pixels
    raw = paths.lower_extension(path).isin(*D.RAW_SIBLINGS)
    rounded = reduce(lambda a, b: a | b, [(width == w) & (height == h) for w, h in ROUND_SIZES])
    sharp = F.least(pixels / 200_000, F.lit(15.0)) if most_pixels is None else F.when(pixels / most_pixels >= 0.99, 10.0).when(pixels / most_pixels >= 0.5, 5.0).otherwise(0.0)
    dense = F.least(density * 100, F.lit(10.0)) if most_density is None else F.when(density / most_density >= 0.95, 10.0).otherwise(0.0)
    score = _sum((is_truncated, -50), (raw, 40), (rounded, -8)) + F.coalesce(sharp, F.lit(0.0)) + F.coalesce(F.when(pixels > 0, dense), F.lit(0.0))
    return _capped(score, "content")


def exif_part(mtime_s):
    """Score of the columns of ``facts``."""
    software = F.lower("software")
    from gleaner.functions.text import exif_seconds, holds_any

    score = _sum(
        (mtime_s < exif_seconds(F.col("date_time_original")), -25), (F.col("compressed_twice"), -25), (F.col("history"), -30), (F.col("maker_note"), 30),
        (F.col("make").isNotNull() & F.col("model").isNotNull(), 20), (F.col("gps"), 15), (F.col("date_time_original") == F.col("date_time"), 8),
        (holds_any(software, EDITORS), -35), ((software == "") | holds_any(software, ("ios", "android", "firmware")), 5), (F.col("color_space"), 5), (~F.col("any_exif"), -10),
    )
    return _capped(score, "exif")


def fs_part(birth_s, oldest):
    """Score of the time a file was made: up for the oldest of a cluster; an unknown time says nothing."""
    return _capped(_sum((birth_s <= oldest, 10)), "fs")


def keeper_scores(pictures: DataFrame) -> DataFrame:
    """``(id, group_id, content, exif, filename, path_score, fs, total)`` of the members of clusters.

    ``pictures`` has ``id``, ``group_id``, ``path``, ``width``, ``height``, ``size_bytes``,
    ``mtime_s``, ``birth_s`` and the columns of ``facts``. Resolution, density and age are
    relative to the cluster's; its extremes are combined before their shuffle, so a cluster
    may have any number of members.
    """
    pixels = (F.col("width") * F.col("height")).cast("double")
    extremes = pictures.groupBy("group_id").agg(
        F.max(pixels).alias("__pixels"), F.max(F.when(pixels > 0, F.col("size_bytes") / pixels)).alias("__density"), F.min("birth_s").alias("__oldest")
    )
    joined = pictures.join(extremes, "group_id")
    path = F.col("path")
    scored = joined.select(
        "id", "group_id",
        content_part(path, F.col("width"), F.col("height"), F.col("size_bytes"), F.col("truncated"), F.col("__pixels"), F.col("__density")).alias("content"),
        exif_part(F.col("mtime_s")).alias("exif"), name_part(path).alias("filename"), path_part(path).alias("path_score"),
        fs_part(F.col("birth_s"), F.col("__oldest")).alias("fs"),
    )
    return scored.withColumn("total", F.col("content") + F.col("exif") + F.col("filename") + F.col("path_score") + F.col("fs"))


#: The version of the fingerprints; cached ones of another version don't count.
VERSION = 1


def metadata(width, height, first_width, first_height, exif=None):
    """What is known of a picture, as JSON: its sizes now and in the file, and ``exif`` (a struct) if given."""
    sides = [width.alias("width"), height.alias("height"), first_width.alias("orig_width"), first_height.alias("orig_height")]
    parts = [
        *sides, F.least(first_width, first_height).alias("min_side"), (width / height).alias("aspect_ratio"),
        (width * height / 1_000_000).alias("megapixels"), F.lit(VERSION).alias("fingerprint_algo_version"),
    ]
    return F.to_json(F.struct(*parts, *([exif.alias("exif")] if exif is not None else [])))


def _rational(parts: tuple[int, int, int]) -> bytes:
    return struct.pack("<6I", parts[0], 1, parts[1], 1, parts[2], 100)


def gps_segment(latitude: float, longitude: float) -> bytes:
    """An APP1 segment whose EXIF holds the place alone: degrees, minutes and hundredths of seconds."""

    def parts(x):
        x = abs(x)
        d = int(x)
        m = int((x - d) * 60)
        return d, m, int(((x - d) * 60 - m) * 6000 + 0.5)

    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    # The directory of the file lies at 8 and points to that of the place at 26, whose two long values follow it.
    first = struct.pack("<H", 1) + entry(0x8825, 4, 1, struct.pack("<I", 26)) + struct.pack("<I", 0)
    at = 26 + 2 + 4 * 12 + 4
    place = struct.pack("<H", 4)
    place += entry(1, 2, 2, (b"N" if latitude >= 0 else b"S").ljust(4, b"\0")) + entry(2, 5, 3, struct.pack("<I", at))
    place += entry(3, 2, 2, (b"E" if longitude >= 0 else b"W").ljust(4, b"\0")) + entry(4, 5, 3, struct.pack("<I", at + 24))
    data = b"Exif\0\0II*\0\x08\0\0\0" + first + place + struct.pack("<I", 0) + _rational(parts(latitude)) + _rational(parts(longitude))
    return b"\xff\xe1" + struct.pack(">H", len(data) + 2) + data


def with_place(content, latitude, longitude):
    """JPEG bytes with a place put in behind their start; as they are without one, or where EXIF is there already."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
        out = []
        for raw, a, b in zip(data, lat, lon, strict=True):
            known = raw is None or raw[:2] != b"\xff\xd8" or any(m == 0xE1 and x[:6] == b"Exif\0\0" for m, x in segments(raw))
            out.append(raw if known or pd.isna(a) or pd.isna(b) else raw[:2] + gps_segment(a, b) + raw[2:])
        return pd.Series(out, dtype=object)

    return run(content, latitude.cast("double"), longitude.cast("double"))
