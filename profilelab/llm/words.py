"""Words of whole texts as 64-bit hashes, computed with array operations over Arrow buffers (helper of Arrow tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# An odd multiplier and its inverse modulo 2**64, and the constants of the 64-bit finalizer.
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_F1, _F2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are runs without ASCII white space, and of words of letters and digits (all non-ASCII counts as such).
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * _F1
    x = (x ^ (x >> np.uint64(27))) * _F2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MUL ** i and its inverse for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_MUL, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: span_hashes takes the hash of any span out of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64)))


@dataclass
class Block:
    """Words of rows first .. first + len(offsets) - 1: hashes[offsets[i]:offsets[i + 1]] are those of row first + i."""

    first: int
    offsets: np.ndarray
    hashes: np.ndarray


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes; a longer row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses a row."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_blocks(texts: pa.Array, kind: np.ndarray, size: int = 2 << 20) -> Iterator[Block]:
    """Word hashes of every row, A-Z lowered, in blocks of about `size` bytes of text."""
    data, offsets = string_parts(texts)
    for a, b in row_groups(offsets, size):
        part, rel = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends = word_spans(part, rel, kind)
        hashes = span_hashes(prefix_hashes(part), starts, ends)
        yield Block(a, np.searchsorted(starts, rel), hashes)
