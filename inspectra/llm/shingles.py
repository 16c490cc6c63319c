"""Word and shingle hashing over Arrow text columns, vectorised over STEP bytes at a time.

A word is a run of bytes other than space and \\t..\\r, A-Z lower-cased; its hash is a polynomial of its bytes modulo 2^64,
mixed. A shingle hash combines `width` consecutive word hashes. 64 bits tell all texts of one corpus apart in practice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15, 400_000
INVERSE = pow(BASE, -1, 1 << 64)
LOWERED = np.arange(256, dtype=np.uint64) + U(1)
LOWERED[65:91] += U(32)
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: list[np.ndarray] = [np.ones(0, U), np.ones(0, U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, STEP), base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def hashed(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words of some bytes, STEP bytes (one word at least) at a time: each byte takes 40 bytes here."""
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
        begin, end = starts[i:j] - starts[i], ends[i:j] - starts[i]
        up, down = powers(int(end[-1]) + 1)
        sums = np.zeros(end[-1] + 1, U)
        np.cumsum(LOWERED[part[starts[i] : ends[j - 1]]] * up[: end[-1]], out=sums[1:])
        out[i:j], i = mixed((sums[end] - sums[begin]) * down[begin]), j
    return out


def word_spans(texts: pa.Array, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (bytes, where words start, where they end, their hashes, where each row's words begin and the last ones end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        part, rows = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        inside = IN_WORD[part]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[rows[:-1][rows[:-1] < len(part)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[rows[1:][rows[1:] > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        yield part, starts, ends, hashed(part, starts, ends), np.searchsorted(starts, rows)
        first = last


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending: all `width` words in a row; fewer words: the whole sequence as one."""
    factors = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(width)], U)
    for _, _, _, hashes, bounds in word_spans(texts):
        n = len(hashes) - width + 1
        rolled = np.zeros(max(n, 0), U)
        for k in range(width):
            if n > 0:
                rolled += hashes[k : k + n] * factors[k]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mixed((hashes[a:b] * factors[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, U)
