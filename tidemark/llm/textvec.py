"""Whole texts as numpy arrays: words, their hashes, shingles and n-grams, without loops over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: At most so many bytes of text are turned into arrays at once; longer texts go in several parts.
PART = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's bounds in them; a null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _cuts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about PART bytes that end at a document's end or just after white space."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + PART, end)
        if to < end:
            i = np.searchsorted(bounds, to, "right") - 1
            if bounds[i] > at:
                to = int(bounds[i])
            else:
                while to < end:
                    near = np.flatnonzero(_is_space(data[to : to + 4096]))
                    if len(near):
                        to += int(near[0]) + 1
                        break
                    to = min(to + 4096, end)
                to = min(to, int(bounds[np.searchsorted(bounds, at, "right")]))
        yield at, to
        at = to


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z in lower case), and where each row's words begin (n + 1 places)."""
    found, firsts = [], []
    for a, b in _cuts(data, bounds):
        part = data[a:b]
        low = np.where((part >= 65) & (part <= 90), part | 32, part)
        space = _is_space(part)
        opens = np.ones(len(part), bool)
        opens[1:] = space[:-1]
        inner = bounds[np.searchsorted(bounds, a, "left") : np.searchsorted(bounds, b, "left")] - a
        opens[inner] = True
        start = np.flatnonzero(opens & ~space)
        if not len(start):
            continue
        closes = np.ones(len(part), bool)
        closes[:-1] = space[1:]
        closes[inner[inner > 0] - 1] = True
        stop = np.flatnonzero(closes & ~space) + 1
        powers = np.full(len(part), _ROOT, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[low] * powers, out=sums[1:])
        powers.fill(_INVERSE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        h = (sums[stop] - sums[start]) * powers[start]
        found.append(mixed(h + (stop - start).astype(np.uint64) * _PLACES[63]))
        firsts.append(start + a)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(firsts), bounds, "left")


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its runs of ``width`` words.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    Two different shingles share a hash with a chance of 2**-64.
    """
    words, at = word_hashes(data, bounds)
    n = len(words)
    runs = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if len(runs) else 0):
        runs += words[k : k + len(runs)] * _PLACES[k]
    runs = mixed(runs)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64) * _PLACES[62]
            yield mixed(short)
        else:
            yield np.zeros(0, np.uint64)


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
