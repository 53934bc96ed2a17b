"""Vectorised text work on Arrow batches: words, hashes and shingles without a Python loop a word.

Hashes of spans come from one running sum over a chunk: with C[k] the sum of value[byte] * P**i
for i < k (mod 2**64), a span's polynomial is (C[end] - C[start]) * P**-start, which two equal
spans share wherever they stand. A final mix spreads it. All constants are fixed, so hashes
agree between tasks, executors and reruns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256)
FOLD[65:91] += 32  # A-Z to a-z, nothing else
LOWER_VALUES = VALUES[FOLD]
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i <= n."""
    for k, base in enumerate((P, P_INVERSE)):
        while len(_powers[k]) <= n:
            _powers[k] = np.concatenate([_powers[k], _powers[k] * (_powers[k][-1:] * base)])
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a chunk; ``values`` has a uint64 for each position."""
    up, down = powers(len(values))
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of an Arrow string array; a null row is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word of a chunk; a word is a run of bytes that aren't ASCII blanks."""
    inside = ~BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1]))) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1 if len(raw) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row of a chunk, the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A-Z are lower-cased. A row of fewer words has one shingle, its whole sequence; a row
    without words has none.
    """
    n = len(offsets) - 1
    starts, ends, row = words(raw, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    h = span_hashes(LOWER_VALUES[raw], starts, ends)
    factors = mix(np.arange(1, width + 2, dtype=np.uint64)) | np.uint64(1)
    many = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(many)))
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, np.uint64)
    for j in range(width):
        s += h[j : j + m] * factors[j]
    s = mix(s)
    out = []
    for i in range(n):
        a, k = first[i], many[i]
        if k >= width:
            out.append(np.unique(s[a : a + k - width + 1]))
        elif k:
            out.append(mix(np.sum(h[a : a + k] * factors[:k], keepdims=True) + np.full(1, k, np.uint64) * factors[width:]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by a 0, row offsets)."""
    cp = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]
