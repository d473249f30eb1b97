"""Whole Arrow batches of text as flat numpy arrays: words, lines, shingles and their hashes.

Nothing here loops over words in Python. A batch's bytes lie end to end; ``bounds`` (n + 1 offsets) says where
each text begins. A hash of a stretch of bytes is the difference of two prefix sums of ``byte * K**i``, freed of
its place by the inverse power, so a batch of any mix of text lengths costs the same per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_K = 0x9E3779B97F4A7C15 | 1
_KINV = pow(_K, -1, 1 << 64)
_SHINGLE = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (an avalanche of xor-shifts and multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def byte_table(pattern: str) -> np.ndarray:
    """True for the bytes of a word. ``space``: all but ASCII white space. ``alnum``: letters, digits, bytes over 127."""
    table = np.zeros(256, bool)
    if pattern == "space":
        table[:] = True
        table[[9, 10, 11, 12, 13, 32]] = False
    elif pattern == "alnum":
        for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
            table[a:b] = True
    else:
        raise ValueError(pattern)
    return table


SPACE, ALNUM = byte_table("space"), byte_table("alnum")


def flat_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, most: int = 1_000_000):
    """Row ranges of about so many bytes each, a single long text at the least."""
    column = column.cast(pa.large_string())
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def stretches(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that are ``inside``; a run never crosses a text's bound."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, equal for equal bytes wherever they lie."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_K, len(raw)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_KINV, len(raw) + 1)[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words."""
    starts, ends = stretches(raw, bounds, table[raw])
    return stretch_hashes(raw, starts, ends), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = 5, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words inside each text, and their bounds.

    ``whole``: a text of fewer words, but one at least, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    full = np.maximum(counts - width + 1, 0)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        rolled = rolled * _SHINGLE + words[j : j + len(rolled)]
    ends = np.cumsum(full)
    out_bounds = np.concatenate([[0], ends]).astype(np.int64)
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], full)
    out = mix64(rolled[at]) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width)) if whole else []
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            here = counts[short] > j
            extra[here] = extra[here] * _SHINGLE + words[bounds[short[here]] + j]
        extra ^= counts[short].astype(np.uint64)
        out = np.insert(out, out_bounds[short], mix64(extra))
        full[short] = 1
        out_bounds = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
    return out, out_bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element the number of the text that owns it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted, and their bounds."""
    who = owners(bounds)
    order = np.lexsort((values, who))
    v, w = values[order], who[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    return v[new], np.concatenate([[0], np.cumsum(np.bincount(w[new], minlength=len(bounds) - 1))]).astype(np.int64)
