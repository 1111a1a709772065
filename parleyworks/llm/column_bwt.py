"""The Burrows-Wheeler transform and common prefixes of a collection of byte strings, built column by column.

All suffixes of one length enter in one round: each string inserts the symbol before its current suffix, from right to left.
The place of a new suffix follows from the place of the suffix without its first symbol (how often that symbol stands before it
in the transform), and its common prefix with either neighbour from the least common prefix between their tails' places. So a
round reads the transform and the common prefixes once, in sequence, and writes them once.
"""

from __future__ import annotations

import numpy as np

#: A byte that no UTF-8 text has; it stands where a string has no further symbol.
END = 0xFF


def _range_minima(values: np.ndarray, longest: int) -> np.ndarray:
    """``table[k, i]`` is the least of the 2**k values from ``i``, as far as ranges of ``longest`` values ask for it."""
    n = len(values)
    table = np.empty((max(1, int(longest).bit_length()), n), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        stop = n - (1 << k) + 1
        np.minimum(table[k - 1, :stop], table[k - 1, 1 << (k - 1) : stop + (1 << (k - 1))], out=table[k, :stop])
    return table


def _least(table: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least value at the places from ``a`` up to ``z``, ``z`` included."""
    level = np.frexp((z - a + 1).astype(np.float64))[1].astype(np.int64) - 1
    flat, row = table.ravel(), level * table.shape[1]
    return np.minimum(flat[row + a], flat[row + z + 1 - (1 << level)])


def _by_symbol(transform: np.ndarray) -> np.ndarray:
    """Places of the symbols, symbol by symbol, without those of ``END``."""
    order = np.argsort(transform, kind="stable")
    return order[: len(order) - int(np.count_nonzero(transform == END))]


def build(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of the strings ``raw[starts:starts + lengths]`` and the common prefix of each suffix with the one before it.

    The empty suffixes come first, in the order of the strings. Ends are all different, so no common prefix holds one. Common
    prefixes are counted up to ``cap`` (below 255).
    """
    m = len(starts)
    ends = starts + lengths

    def symbol(strings: np.ndarray, done: int) -> np.ndarray:
        """The symbol before the last ``done`` ones."""
        left = lengths[strings] > done
        return np.where(left, raw[np.where(left, ends[strings] - done - 1, 0)], END).astype(np.uint8)

    active = np.arange(m)
    transform = symbol(active, 0) if len(raw) else np.full(m, END, np.uint8)
    common = np.zeros(m, np.uint8)
    place = np.arange(m)
    tails = np.zeros(0, np.int64)  # of the suffixes that aren't empty: where the suffix without the first symbol stands
    firsts = np.zeros(256, np.int64)  # how many begin with each symbol
    done = 0
    while True:
        own = transform[place]
        by = np.argsort(own, kind="stable")  # places ascend, so these are in the order of the new suffixes
        by = by[: len(by) - int(np.count_nonzero(own == END))]
        if not len(by):
            return transform, common
        active, place, own = active[by], place[by], own[by]
        n = len(transform)
        keys = tails + np.repeat(np.arange(256) * n, firsts)
        floor = own.astype(np.int64) * n
        earlier = np.searchsorted(keys, place + floor)
        at = earlier + np.arange(len(active))
        before = np.where(earlier > 0, keys[np.maximum(earlier - 1, 0)] - floor, -1) if len(keys) else np.full(len(active), -1)
        after = np.where(earlier < len(keys), keys[np.minimum(earlier, len(keys) - 1)] - floor, n) if len(keys) else np.full(len(active), n)
        same = own[1:] == own[:-1]
        before[1:] = np.where(same, np.maximum(before[1:], place[:-1]), before[1:])
        after[:-1] = np.where(same, np.minimum(after[:-1], place[1:]), after[:-1])
        has_before, has_after = before >= 0, after < n
        a, z = before[has_before] + 1, place[has_before]
        b, y = place[has_after] + 1, after[has_after]
        minima = _range_minima(common, max((z - a).max(initial=0), (y - b).max(initial=0)) + 1)
        with_before = np.zeros(len(active), np.uint8)
        with_before[has_before] = np.minimum(_least(minima, a, z), cap - 1) + 1
        with_after = np.minimum(_least(minima, b, y), cap - 1) + 1
        done += 1
        new = at + m
        old = np.ones(n + len(active), bool)
        old[new] = False
        moved = np.flatnonzero(old)
        grown, longer, further = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8), np.empty(len(old) - m, np.int64)
        grown[old], longer[old], further[old[m:]] = transform, common, moved[tails]
        grown[new], longer[new], further[at] = symbol(active, done), with_before, moved[place]
        longer[new[has_after] + 1] = with_after
        transform, common, place, tails = grown, longer, new, further
        firsts += np.bincount(own, minlength=256)


def suffix_places(transform: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, string, suffix length) of every suffix of at least ``least`` symbols, found by walking back through the transform."""
    m = len(lengths)
    order = _by_symbol(transform)
    step = np.full(len(transform), -1, np.int64)
    step[order] = np.arange(len(order)) + m
    place, string = np.arange(m), np.arange(m)
    found = []
    for done in range(int(lengths.max(initial=0)) + 1):
        alive = lengths[string] >= done
        place, string = place[alive], string[alive]
        if done >= least:
            found.append((place, string, np.full(len(place), done)))
        place = step[place]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
