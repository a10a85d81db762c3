"""Vectorised word work on Arrow string columns: word bounds and 64-bit word hashes.

A column's bytes are taken in chunks of whole texts (about ``CHUNK_BYTES`` each, a longer text
alone), so memory follows the chunk, not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes hashed at a time inside a chunk; a longer text is hashed in blocks cut between words.
BLOCK_BYTES = 1 << 21

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C55  # odd: its powers never vanish mod 2**64


class Words(NamedTuple):
    """Words of several texts, in order. ``doc``: index of the text within the chunk;
    ``start`` / ``end``: byte bounds in ``data``; ``text_start``: byte bounds of the texts."""

    data: np.ndarray
    text_start: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.text_start) - 1)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text bounds) for runs of whole texts of about ``size`` bytes."""
    raw, offs = string_buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words_of(data: np.ndarray, text_start: np.ndarray, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``; no word crosses a text bound."""
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    n = len(data)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = text_start[(text_start > 0) & (text_start < n)]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(text_start, start, side="right") - 1
    return Words(data, text_start, doc, start, end)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), on uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, then mixed."""
    out = np.empty(len(w.start), dtype=np.uint64)
    at = 0
    while at < len(w.start):
        base = w.start[at]
        last = max(at + 1, int(np.searchsorted(w.end, base + BLOCK_BYTES, side="right")))
        s, e = w.start[at:last] - base, w.end[at:last] - base
        block = w.data[base : base + e[-1]]
        length = e - s
        before = np.concatenate(([0], np.cumsum(length)[:-1]))
        within = np.arange(length.sum()) - np.repeat(before, length)
        value = (block[within + np.repeat(s, length)].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[within]
        out[at:last] = np.add.reduceat(value, before)
        at = last
    return mix(out)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), np.uint64(_BASE), dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def shingle_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word's index) of every run of ``k`` words within one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + h[i : i + n]
        out = mix(out)
    first = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return out[first], first
