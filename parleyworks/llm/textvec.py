"""Vectorised word hashing on Arrow string columns.

The helpers look at the UTF-8 bytes that Arrow already holds, so no Python string is made.
A word is a maximal run of bytes that ``keep`` marks; its hash is a polynomial modulo 2**64,
taken from one running sum, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Letters: ASCII letters and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Letters and ASCII digits.
ALNUM = LETTERS.copy()
ALNUM[48:58] = True
#: Everything but the ASCII white space that separates words.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, *range(9, 14)]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, _CHUNK + 4096)
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def text_slices(column: pa.Array, budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes of text, one row at least."""
    _, offsets = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(
    raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray, fold: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and the number of words in every row.

    Works through the bytes in pieces that end where a word ends, so the memory beside the
    result does not grow with a text.
    """
    hashes, firsts = [], []
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(lo + _CHUNK, n)
        while hi < n and keep[raw[hi]] and keep[raw[hi - 1]]:
            run = keep[raw[hi : hi + _CHUNK]]
            hi += int(np.argmin(run)) if not run.all() else len(run)
        b = _FOLD[raw[lo:hi]] if fold else raw[lo:hi]
        inside = keep[b]
        a, z = np.searchsorted(offsets, (lo, hi))
        row_starts = offsets[a:z] - lo
        row_starts = row_starts[row_starts < hi - lo]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[row_starts] = inside[row_starts]
        ends = np.zeros(hi - lo + 1, bool)
        ends[1:-1] = inside[:-1] & (~inside[1:] | begins[1:])
        ends[-1] = inside[-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends)
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        firsts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    h, s = np.concatenate(hashes), np.concatenate(firsts)
    return h, s, np.diff(np.searchsorted(s, offsets))


def hash_word(word: str, keep: np.ndarray) -> np.uint64:
    """The hash that ``word_hashes`` gives one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    h, _, counts = word_hashes(raw, np.array([0, len(raw)]), keep)
    if len(h) != 1:
        raise ValueError(f"not one word: {word!r}")
    return h[0]


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``size`` consecutive words, row after row, and their number by row.

    A row with fewer words, but one at least, has a single shingle of all of them; a row without
    words has none.
    """
    n_rows, n = len(counts), len(words)
    row = np.repeat(np.arange(n_rows), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(n) - first[row]
    left = np.asarray(counts)[row] - place
    starts = np.flatnonzero((left >= size) | (place == 0))
    h = np.zeros(len(starts), np.uint64)
    span = np.minimum(left[starts], size)
    for i in range(size):
        inside = i < span
        at = starts[inside] + i
        h[inside] = mix(h[inside] * np.uint64(_P) + words[at] + np.uint64(i + 1))
    r = row[starts]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.bincount(r[new], minlength=n_rows)
