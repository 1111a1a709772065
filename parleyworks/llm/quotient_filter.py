"""Counting quotient filters of 64-bit fingerprints, as sorted arrays.

A fingerprint of ``bits`` bits splits into a quotient (its high bits) and a remainder. The filter
keeps one bit for each quotient in use, one bit for the end of each quotient's run, the remainders
in sorted order, and the counts above one. Quotient and remainder together are the whole
fingerprint, so filters of different sizes merge without loss.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBQQ")


def pack(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of sorted distinct fingerprints (uint64 below 2**bits) with their counts."""
    n = len(fingerprints)
    q = max(n - 1, 0).bit_length()
    r = bits - q
    quotients = fingerprints >> np.uint64(r)
    remainders = fingerprints & np.uint64((1 << r) - 1)
    used = np.zeros(1 << q, bool)
    used[quotients.astype(np.int64)] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotients[1:] != quotients[:-1]
    width = (r + 7) // 8
    low = remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    many = np.flatnonzero(counts > 1)
    return b"".join(
        (
            _HEAD.pack(q, bits, n, len(many)),
            np.packbits(used).tobytes(),
            np.packbits(ends).tobytes(),
            low.tobytes(),
            many.astype("<u8").tobytes(),
            counts[many].astype("<u8").tobytes(),
        )
    )


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and their counts."""
    q, bits, n, n_many = _HEAD.unpack_from(packed)
    at = _HEAD.size
    r, width = bits - q, (bits - q + 7) // 8

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(packed, np.uint8, size, at - size)

    used = np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q)
    ends = np.unpackbits(take((n + 7) // 8), count=n).astype(np.int64)
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = take(n * width).reshape(n, width)
    many = take(8 * n_many).view("<u8").astype(np.int64)
    above = take(8 * n_many).view("<u8")
    quotients = np.flatnonzero(used).astype(np.uint64)[np.cumsum(ends) - ends] if n else np.zeros(0, np.uint64)
    counts = np.ones(n, np.uint64)
    counts[many] = above
    shifted = quotients << np.uint64(r) if r < 64 else quotients * np.uint64(0)
    return shifted | full.view("<u8").ravel(), counts


def add_up(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with the sums of their counts."""
    order = np.argsort(fingerprints, kind="stable")
    f, c = fingerprints[order], counts[order]
    first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
    return f[first], np.add.reduceat(c, first) if len(f) else c


def merge(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One filter's content from many: runs of sorted remainders merge and their counts add up."""
    parts = [unpack(p) for p in packed]
    return add_up(np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts]))
