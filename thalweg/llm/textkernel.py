"""Vectorised text primitives over Arrow string columns: words, word hashes, five-word shingles.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D}; ASCII letters count in lower case.  Work goes through pieces of
about one megabyte that end at white space, so memory does not grow with the length of a text beyond 8 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation, for words without punctuation.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (shift-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))[LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(PIECE + 1, n)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, U64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if buffers[1] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, budget: int = 4 << 20):
    """Ranges of documents of about ``budget`` bytes each, one document at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _edges(block: np.ndarray, breaks: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~space[block]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = breaks[breaks > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, spans: bool = False, space: np.ndarray = SPACE):
    """Hashes of all words of the documents, and the number of words before each document (n + 1); with ``spans`` also the
    words' byte starts and ends, counted from offsets[0]."""
    base, stop = int(offsets[0]), int(offsets[-1])
    hashes, starts, ends = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = base
    while lo < stop:
        hi = min(stop, lo + PIECE)
        while hi < stop:
            gap = np.flatnonzero(space[data[max(lo, hi - 65536) : hi]])
            if len(gap):
                hi = max(lo, hi - 65536) + int(gap[-1]) + 1
                break
            inner = np.searchsorted(offsets, hi, side="right") - 1
            if offsets[inner] > lo:
                hi = int(offsets[inner])
                break
            hi = min(stop, hi + PIECE)
        block = data[lo:hi]
        a, b = np.searchsorted(offsets, lo, side="left"), np.searchsorted(offsets, hi, side="left")
        s, e = _edges(block, offsets[a:b] - lo, space)
        up, down = _powers(len(block) + 1)
        total = np.zeros(len(block) + 1, U64)
        np.cumsum(_BYTE[block] * up[:-1], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)))
        starts.append(s + (lo - base))
        if spans:
            ends.append(e + (lo - base))
        lo = hi
    starts = np.concatenate(starts)
    before = np.searchsorted(starts, offsets - base, side="left")
    before[-1] = len(starts)
    out = np.concatenate(hashes)
    return (out, before, starts, np.concatenate(ends)) if spans else (out, before)


_TURN = U64(0xA24BAED4963EE407)
WIDTH = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each document as sorted 64-bit hashes, flat, with the set boundaries (n + 1).  A
    document of one to four words has its whole sequence as one shingle; one without words has none."""
    hashes, before = words(data, offsets)
    n_words = np.diff(before)
    if len(hashes) >= WIDTH:
        rolled = hashes[: len(hashes) - WIDTH + 1].copy()
        for k in range(1, WIDTH):
            rolled *= _TURN
            rolled += hashes[k : len(hashes) - WIDTH + 1 + k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, U64)
    parts, sizes = [], np.zeros(len(n_words), np.int64)
    for d, n in enumerate(n_words.tolist()):
        at = int(before[d])
        if n >= WIDTH:
            own = np.unique(rolled[at : at + n - WIDTH + 1])
        elif n:
            value = U64(n)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + n]:
                    value = value * _TURN + h
            own = mix(np.array([value], U64) ^ U64(0x5851F42D4C957F2D))
        else:
            continue
        sizes[d] = len(own)
        parts.append(own)
    bounds = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), bounds


def set_ids(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit id per set from the sum of its scrambled members and its size (0 for the empty set)."""
    total = np.zeros(len(flat) + 1, U64)
    np.cumsum(mix(flat ^ U64(0xC2B2AE3D27D4EB4F)), out=total[1:])
    n = np.diff(bounds).astype(U64)
    return np.where(n > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + n * U64(0x9FB21C651E98DF25)), U64(0))
