"""Character n-gram hash vectors, worked out row by row inside Arrow batches: nothing is exploded or moved.

A text is lower-cased and stripped; each of its distinct n-grams adds a sign to a slot, both from the
n-gram's md5. The empty text has the empty n-gram; null counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import blocks


class _Hashes:
    """2 * slot + sign bit of n-grams; one seen before is not hashed again, up to ``keep`` of them, which lie in two sorted arrays."""

    def __init__(self, dims: int, keep: int = 1_000_000):
        self.dims, self.keep, self.known, self.codes = dims, keep, np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _code(self, key: int) -> int:
        digest = hashlib.md5("".join(chr((key >> at & _POINT) - 1) for at in _PLACES if key >> at & _POINT).encode()).digest()
        return 2 * (int.from_bytes(digest[:4], "big") % self.dims) + digest[4] % 2

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The codes of n-grams given by their keys (see ``_grams``), which are distinct and in order."""
        at = np.searchsorted(self.known, keys)
        old = np.zeros(len(keys), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == keys[inside]
        out = np.empty(len(keys), np.int64)
        out[old] = self.codes[at[old]]
        new = keys[~old]
        out[~old] = np.fromiter(map(self._code, new.tolist()), np.int64, len(new))
        if len(self.known) + len(new) <= self.keep:
            self.known, self.codes = np.insert(self.known, at[~old], new), np.insert(self.codes, at[~old], out[~old])
        elif len(new):
            self.known, self.codes = new[: self.keep], out[~old][: self.keep].astype(np.int32)
        return out


_POINT = (1 << 21) - 1
_PLACES = (0, 21, 42)


def _grams(texts: Sequence[str], largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct n-grams of each text, by sliding windows over code points.

    A key holds the n-gram's code points plus one, 21 bits each, so it is the n-gram itself; the key of the empty n-gram is 0.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # code points from each place to the end of its text
    key, rows, keys = np.zeros(len(points), np.uint64), [np.flatnonzero(lengths == 0)], [np.zeros(int((lengths == 0).sum()), np.uint64)]
    for n in range(1, largest + 1):
        at = np.flatnonzero(left >= n)
        key[at] |= points[at + n - 1] << np.uint64(_PLACES[n - 1])
        rows.append(row[at])
        keys.append(key[at])
    r, k = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((k, r))
    r, k = r[order], k[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return r[new], k[new]


def _counts(texts: Sequence[str | None], hashes: _Hashes, largest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, how many n-grams of each text add to and take from each slot), for some texts at a time."""
    if not 1 <= largest <= len(_PLACES):
        raise ValueError(f"n-grams of 1 to {len(_PLACES)} characters")
    said = [(t or "").lower().strip() for t in texts]
    lo = 0
    while lo < len(said):
        hi, size = lo, 0
        while hi < len(said) and hi - lo < 1024 and (hi == lo or size + len(said[hi]) <= 1 << 18):
            size += len(said[hi])
            hi += 1
        row, key = _grams(said[lo:hi], largest)
        distinct, place = np.unique(key, return_inverse=True)
        slot = row * (2 * hashes.dims) + hashes.of(distinct)[place]
        yield lo, np.bincount(slot, minlength=(hi - lo) * 2 * hashes.dims).reshape(hi - lo, hashes.dims, 2)
        lo = hi


def _schema(df: DataFrame, without: str = "") -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != without)


def sparse_vectors(df: DataFrame, text: str, dims: int = 256, largest: int = 3) -> DataFrame:
    """``df`` without ``text``, a row for each slot that the text's n-grams touch, with ``slot`` and ``value``."""
    rest = [f.name for f in df.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(dims)
        for batch in batches:
            for first, some in blocks(batch.column(batch.schema.get_field_index(text))):
                both = np.concatenate([x for _, x in _counts(some, hashes, largest)])
                row, slot = np.nonzero(both.sum(2))
                again = batch.select(rest).take(pa.array(row + first))
                value = (both[..., 0] - both[..., 1])[row, slot]
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(slot.astype(np.int32)), pa.array(value.astype(np.int64))], [*rest, "slot", "value"])

    return df.mapInArrow(run, f"{_schema(df, text)}slot int, value long")


def dense_vectors(df: DataFrame, text: str, name: str, dims: int = 256, largest: int = 3, unit: bool = True) -> DataFrame:
    """``df`` with the vector of ``text`` as ``name``, of length one if ``unit`` (a vector of zeros stays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(dims)
        for batch in batches:
            for lo, some in blocks(batch.column(batch.schema.get_field_index(text))):
                v = _matrix(some, hashes, largest)
                if unit:
                    v /= np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-300)
                offsets = pa.array(np.arange(0, v.size + 1, dims, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(some)).columns, pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], [*batch.schema.names, name])

    return df.mapInArrow(run, f"{_schema(df)}`{name}` array<double>")


def _matrix(texts: Sequence[str | None], hashes: _Hashes, largest: int) -> np.ndarray:
    out = np.zeros((len(texts), hashes.dims))
    for lo, both in _counts(texts, hashes, largest):
        out[lo : lo + len(both)] = both[..., 0] - both[..., 1]
    return out


def _cosines(v: np.ndarray, sides: np.ndarray, first: np.ndarray, cells: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, largest cosine of each row with the templates of each label), for as many rows at a time as give ``cells`` cosines."""
    size, own = np.sqrt((v**2).sum(1)), np.sqrt((sides**2).sum(1))
    step = max(1, cells // max(len(sides), 1))
    for lo in range(0, len(v), step):
        norms = size[lo : lo + step, None] * own[None, :]
        cosine = np.divide(v[lo : lo + step] @ sides.T, norms, out=np.zeros_like(norms), where=norms > 0)
        yield lo, np.maximum.reduceat(cosine, first, axis=1)


def best_template(
    df: DataFrame, text: str, templates: Sequence[tuple[str, Sequence[str]]], name: str = "match", dims: int = 256, largest: int = 3, other: str = "other"
) -> DataFrame:
    """``df`` with ``name`` (label, confidence): the label whose nearest template has the largest cosine.

    Templates are given (a parameter) and go to every task, which meets them in blocks of rows. Ties, to nine digits, go to the label
    first in order; where no cosine is above 0, or a vector is all zeros, it is ``other`` with 0.
    """
    kind = pa.struct([("label", pa.string()), ("confidence", pa.float64())])
    given = [(label, texts) for label, texts in templates if texts]
    labels = [label for label, _ in given]
    first = np.cumsum([0, *(len(texts) for _, texts in given)])[:-1].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(dims)
        sides = _matrix([t for _, texts in given for t in texts], hashes, largest)
        for batch in batches:
            for begin, some in blocks(batch.column(batch.schema.get_field_index(text))):
                v = _matrix(some, hashes, largest)
                top, score = np.zeros(len(v), int), np.zeros(len(v))
                for lo, best in _cosines(v, sides, first) if labels else ():
                    at = np.round(best, 9).argmax(1)
                    top[lo : lo + len(at)], score[lo : lo + len(at)] = at, best[np.arange(len(at)), at]
                said = [{"label": labels[t], "confidence": float(s)} if s > 0 else {"label": other, "confidence": 0.0} for t, s in zip(top, score, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(some)).columns, pa.array(said, kind)], [*batch.schema.names, name])

    return df.mapInArrow(run, f"{_schema(df)}`{name}` struct<label:string,confidence:double>")
