"""Digests of regions of binary columns.

SHA-256 stands in for any collision-resistant digest: only equality of digests is observable.
"""

from __future__ import annotations

from pyspark.sql import functions as F

CHUNK = 4096


def prefix(data, n: int):
    return F.substring(data, 1, n)


def suffix(data, n: int):
    """The last ``n`` bytes, or everything if there are fewer."""
    return F.when(F.octet_length(data) <= n, data).otherwise(F.substring(data, -n, n))


def middle(data, offset: int, n: int):
    """``n`` bytes from ``offset``, as many as there are."""
    return F.substring(data, offset + 1, n)


def head_tail(data, head: int = CHUNK, tail: int = CHUNK):
    """Head and tail that never overlap: everything where they would meet."""
    return F.when(region_covers(F.octet_length(data), head + tail), data).otherwise(
        F.concat(F.substring(data, 1, head), F.substring(data, -tail, tail))
    )


def sampled(data, samples):
    """Several (offset, length) pieces in a row; null if one lies past the end."""
    last = max(o + n for o, n in samples)
    return F.when(F.octet_length(data) >= last, F.concat(*[F.substring(data, o + 1, n) for o, n in samples]))


def region_covers(size, n: int):
    """Whether a region of ``n`` bytes holds the whole of a file."""
    return size <= n


def digest(data):
    return F.sha2(data, 256)


def from_hex(text):
    """32 bytes of 64 hex digits in either case; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def to_hex(data):
    return F.lower(F.hex(data))


def partial_digest(data, head_only: bool = False, chunk: int = CHUNK):
    return digest(prefix(data, chunk) if head_only else head_tail(data, chunk, chunk))
