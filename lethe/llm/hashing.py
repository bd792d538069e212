"""Vectorised 64-bit hashes of words and shingles over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Texts are read straight from
the Arrow buffer in blocks of half a megabyte, so memory does not depend on the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; a null is an empty text."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] and len(col.buffers()[2]) else np.zeros(0, np.uint8)
    return data, offsets


def _block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of data; a word never crosses one of the breaks."""
    keep = ~_SPACE[data]
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = keep[inner]
    last[inner - 1] = keep[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(16, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(size, _MULT)[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * _powers(size, _INV)[starts])


def _long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _block for one text of any length, cut at white space into blocks."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            space = np.flatnonzero(_SPACE[data[at:end]])
            while not len(space) and end < len(data):  # a word longer than a block
                end = min(len(data), end + BLOCK)
                space = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(space[-1]) + 1 if len(space) and end < len(data) else end
        s, e, h = _block(data[at:end], np.zeros(0, np.int64))
        found.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)


def words(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole rows: (first row, row after the last, bytes, word starts, word ends, word hashes, bounds).

    bounds has one entry more than there are rows: row i of the block owns words bounds[i]:bounds[i + 1].
    """
    data, offsets = buffers(col)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1
        end = min(rows, max(end, at + 1))
        part, cuts = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        starts, ends, hashes = _long(part) if end == at + 1 else _block(part, cuts)
        yield at, end, part, starts, ends, hashes, np.searchsorted(starts, cuts)
        at = end


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n consecutive words, sorted; of the whole sequence if it is shorter; none of no words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : len(hashes) - n + 1 + i] + np.uint64(n))
    return np.unique(out)
