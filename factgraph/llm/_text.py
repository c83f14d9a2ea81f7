"""Vectorised text primitives on Arrow buffers: word bounds, 64-bit word hashes and code points of many texts at once.

A *batch* is the UTF-8 bytes of several texts laid end to end and their n + 1 offsets. White space is
U+0020 and U+0009 to U+000D throughout, so that words never depend on a locale or a Unicode version.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def cut(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of its text. gaps: by byte, whether it separates words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gaps[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[:-1]] = True
    edge[len(data)] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of a prefix polynomial."""
    if not len(starts):
        return np.zeros(0, U64)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power(_BASE, len(data)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def window_hashes(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each `width` consecutive words of one text and their texts; a text of fewer words gives one window, of all its words."""
    n = len(hashes)
    if not n:
        return hashes, doc
    counts = np.bincount(doc, minlength=int(doc[-1]) + 1)
    short = counts[doc] < width
    size = max(0, n - width + 1)
    total = np.zeros(size, U64)
    for j in range(width):
        total += hashes[j : j + size] * U64(pow(0xD1342543DE82EF95, j + 1, 2**64))
    ok = doc[:size] == doc[width - 1 : width - 1 + size] if size else np.zeros(0, bool)
    full, full_doc = mix(total[ok]), doc[:size][ok]
    if short.any():
        index = np.flatnonzero(short)
        d = doc[index]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        place = np.arange(len(index)) - np.repeat(first, np.diff(np.r_[first, len(index)]))
        part = hashes[index] * _power(0xD1342543DE82EF95, width + 1)[place + 1]
        few = mix(np.add.reduceat(part, first) + U64(1))
        full, full_doc = np.r_[full, few], np.r_[full_doc, d[first]]
        order = np.argsort(full_doc, kind="stable")
        full, full_doc = full[order], full_doc[order]
    return full, full_doc


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and offsets in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offsets]
