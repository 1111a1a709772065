"""Removal of repeated passages with suffix arrays that are built column by column over partitions of a collection.

A passage is ``width`` bytes that also start in a document with a smaller id; every byte of a later one goes. The suffix order of
a whole corpus is no work for one task, and a document may be long, so the collection is first cut where equal passages cannot be
parted: the anchor of a window of ``width`` bytes is its ``gram``-byte string of least hash, a function of the window's bytes
alone. Neighbouring windows with one anchor form a piece, and all pieces of an anchor go to one bucket. Each bucket is a collection
of short strings whose transform and common prefixes ``column_bwt`` builds by inserting one symbol of every string a round;
suffixes with common prefixes of ``width`` or more are one group, and the group's least document keeps its bytes.

The steps, each a Spark job over written tables or shuffles:

1. Texts are written in compressed blocks of about ``block`` bytes.
2. Each block sends the hashes of its anchors, with the number of its documents that have them, to their buckets, which send back
   those of two documents or more. No other piece can be repeated, so no other text moves.
3. Blocks send the pieces of those anchors to buckets of about twice ``bucket`` pieces, those of several blocks together; the
   transform is built there, for ``bucket`` pieces at a time. Equal pieces enter it as one string with the least id; a string that is
   alone with its anchor has no other to meet, and windows at either end whose hash no other string has are in no other.
4. An anchor in over ``hot`` documents is dealt by document to several buckets. There the first document with a window is found as
   elsewhere; the windows that remain go once more, one by one, to buckets by their whole content, so no bucket has more copies of
   a window than there were buckets of its anchor.
5. Blocks meet the removed spans and hash what is left.

The hot anchors, the repeated ones and all spans are rows of shuffled tables: nothing of the corpus is broadcast or collected.

Defined results: null text is empty; a null id is larger than every other and rows with equal ids leave each other alone;
rows that repeat are rows each; within a document nothing is compared with itself; texts below ``width`` bytes stay whole; a very
long text is one block, read in slices; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .column_bwt import build, suffix_places
from .common import bounded_batches, discard, settle
from .textvec import mix

_NONE = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 16


def _zip(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unzip(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""


def _array(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_unzip(packed), kind)


def blocks(docs: DataFrame, block: int) -> DataFrame:
    """(block, ids, sizes, texts): documents in order, their texts one after the other."""
    bounded_batches(docs)
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, size = 0, 0, 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def out() -> pa.RecordBatch:
            made = [[(part << 32) + no], [list(ids)], [[len(x) for x in texts]], [_zip(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

        for batch in batches:
            for p, i, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                part = p.as_py()
                raw = text.as_buffer().to_pybytes()
                if texts and size + len(raw) > block:
                    yield out()
                    ids, texts, size, no = [], [], 0, no + 1
                ids.append(i.as_py())
                texts.append(raw)
                size += len(raw)
        if texts:
            yield out()

    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])
    return rows.mapInArrow(run, "block long, ids array<long>, sizes array<long>, texts binary")


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a multiple of eight) from each place."""
    eight = raw.astype(np.uint64)
    for k in (1, 2, 4):
        eight = eight[:-k] | (eight[k:] << np.uint64(8 * k))
    n = len(raw) - gram + 1
    h = eight[:n]
    for k in range(8, gram, 8):
        h = mix(h) * _ODD + eight[k : k + n]
    return mix(h)


def pieces(raw: np.ndarray, ends: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, anchor) of the pieces of texts that end at ``ends``, slice after slice.

    A slice may cut a piece in two, and no piece has more windows than a window has anchors to choose from; the parts have its anchor.
    """
    count = width - gram + 1
    for lo in range(0, len(raw) - width + 1, _SLICE):
        least, done = _gram_hashes(raw[lo : lo + _SLICE + width - 1], gram), 1
        while 2 * done <= count:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if done < count:
            least = np.minimum(least[: len(least) - (count - done)], least[count - done :])
        n = len(least)
        fits = np.ones(n, bool)
        for end in ends[slice(*np.searchsorted(ends, (lo + 1, lo + n + width)))]:  # windows that would cross the end of a text
            fits[max(0, end - width + 1 - lo) : end - lo] = False
        fresh = np.ones(n, bool)
        fresh[1:] = (least[1:] != least[:-1]) | ~fits[:-1]
        first = np.flatnonzero(fresh & fits)
        stop = np.flatnonzero(fits & np.append(fresh[1:] | ~fits[1:], True)) + 1
        anchor = mix(least[first] * _ODD)  # least hashes are small: spread them again
        parts = -(-(stop - first) // count)  # where a text repeats itself, one anchor goes on for longer
        no = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + no * count
        yield begin + lo, np.minimum(np.repeat(stop, parts) - begin, count), np.repeat(anchor, parts)


def _owned(anchors: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors, sorted, and the number of texts that have each."""
    order = np.argsort(anchors)
    h = anchors[order]
    new = np.append(True, h[1:] != h[:-1])
    first = np.flatnonzero(new)
    n = np.ones(len(first), np.int64)
    often = np.flatnonzero(np.diff(np.append(first, len(h))) > 1)  # few have more than one piece
    if len(often):
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        which, owner = (np.cumsum(new) - 1)[at], owners[order[at]]
        order = np.lexsort((owner, which))
        which, owner = which[order], owner[order]
        n[often] = np.bincount(np.searchsorted(often, which[np.append(True, (which[1:] != which[:-1]) | (owner[1:] != owner[:-1]))]), minlength=len(often))
    return h[first], n


def _anchor_rows(width: int, gram: int, buckets: int):
    """Block -> (bucket, block, n, anchors): each anchor of the block with the number of its texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, ends = np.frombuffer(_unzip(row["texts"]), np.uint8), np.cumsum(row["sizes"])
                for anchors, owners, _, _ in _segments(raw, ends, width, gram):
                    h, n = _owned(anchors, owners)
                    cuts = np.searchsorted(h, (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64))
                    parts = zip(np.split(h, cuts), np.split(n, cuts), strict=True)
                    made = [(b, row["block"], len(x), _zip(x.astype("<u8").tobytes() + np.minimum(c, 1 << 30).astype("<u4").tobytes())) for b, (x, c) in enumerate(parts) if len(x)]
                    if made:
                        yield _batch(made, ("bucket", "block", "n", "anchors"), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))

    return run


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _segments(raw: np.ndarray, ends: np.ndarray, width: int, gram: int, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, text number, first window, number of windows) of about ``size`` pieces at a time."""
    held: list[tuple] = []
    n = 0
    for found in pieces(raw, ends, width, gram):
        held.append(found)
        n += len(found[0])
        if n >= size:
            first, count, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
            yield anchor, np.searchsorted(ends, first, "right"), first, count
            held, n = [], 0
    if n:
        first, count, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        yield anchor, np.searchsorted(ends, first, "right"), first, count


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with the same bucket, across batches."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != key and rows:
                yield rows
                rows = []
            key = row["bucket"]
            rows.append(row)
    if rows:
        yield rows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket -> (block, anchors, total): for each block its anchors of two texts or more, with the number of texts in all."""
    for rows in _runs(batches):
        held = [(r["block"], np.frombuffer(x, "<u8", r["n"]), np.frombuffer(x, "<u4", offset=8 * r["n"])) for r in rows for x in (_unzip(r["anchors"]),)]
        h = np.concatenate([x for _, x, _ in held])
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1])
        total = np.zeros(len(h), np.int64)
        total[order] = np.add.reduceat(np.concatenate([n for _, _, n in held]).astype(np.int64)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        made, lo = [], 0
        for block, x, n in held:
            own = total[lo : lo + len(x)]
            lo += len(x)
            some = own > 1
            if some.any():
                made.append((block, _zip(x[some]), _zip(own[some].astype("<u8")), int(n[some].sum())))
        if made:
            yield _batch(made, ("block", "anchors", "totals", "n"), (pa.int64(), pa.binary(), pa.binary(), pa.int64()))


_PIECES = ("bucket", "final", "n", "pieces")
_PIECE_KINDS = (pa.int64(), pa.bool_(), pa.int32(), pa.binary())
_PIECE_SCHEMA = "bucket long, final boolean, n int, pieces binary"
_COLUMNS = (("hash", "<u8"), ("doc", "<i8"), ("block", "<i8"), ("first", "<i8"), ("owner", "<i4"), ("count", "u1"))


def _pack(columns: list[np.ndarray], text: np.ndarray) -> bytes:
    """Pieces column by column, in the order of their hashes, and their text."""
    columns = [np.diff(columns[0], prepend=np.uint64(0)), *columns[1:]]
    held = _zip(b"".join(c.astype(kind, copy=False).tobytes() for c, (_, kind) in zip(columns, _COLUMNS, strict=True)))
    return len(held).to_bytes(8, "little") + held + _zip(text)


def _unpack(packed: bytes, n: int) -> tuple[list[np.ndarray], bytes]:
    cut = 8 + int.from_bytes(packed[:8], "little")
    raw, at, columns = _unzip(packed[8:cut]), 0, []
    for _, kind in _COLUMNS:
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    return [np.cumsum(columns[0]), *columns[1:]], _unzip(packed[cut:])


def _gather(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the strings, one after the other."""
    longest = int(length.max(initial=0))
    if not longest:
        return np.zeros(0, np.uint8)
    windows, place, out = np.lib.stride_tricks.sliding_window_view(raw, longest), np.arange(longest, dtype=np.int16), []
    for lo in range(0, len(first), 1 << 12):
        at, n = first[lo : lo + (1 << 12)], length[lo : lo + (1 << 12)]
        start = np.minimum(at, len(windows) - 1)
        begin, end = (x.astype(np.int16)[:, None] for x in (at - start, at - start + n))
        out.append(windows[start][(place >= begin) & (place < end)])
    return np.concatenate(out)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; it grows with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _piece_rows(raw: np.ndarray, buckets: int, final: bool, columns: list[np.ndarray], start: np.ndarray, some: np.ndarray, width: int) -> Iterator[list[tuple]]:
    """A row for each bucket of ``some`` pieces, by their hashes, 64 rows at a time. ``start`` says where in ``raw`` they stand."""
    some = some[np.argsort(columns[0][some])]
    bucket = _bucket(columns[0][some], buckets)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(some)]
    made = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = some[lo:hi]
        own = [c[at] for c in columns]
        made.append((int(bucket[lo]), final, hi - lo, _pack(own, _gather(raw, start[at], own[-1].astype(np.int64) + width - 1))))
        if len(made) == 64:
            yield made
            made = []
    if made:
        yield made


def _sent_pieces(width: int, gram: int, buckets: int, hot: int, most: int = 1 << 18, text: int = 16 << 20):
    """Blocks with their repeated anchors -> pieces by bucket.

    Pieces leave together when there are ``most`` or they lie in ``text`` bytes, whatever block they are of. So a row has the more of
    them the fewer buckets there are, and the number of rows doesn't grow with blocks times buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[np.ndarray] = []
        held: list[tuple] = []
        n = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            raw = np.concatenate(texts) if len(texts) > 1 else texts[0]
            texts.clear()
            if not held:
                return
            final, start, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for kind in (True, False):
                some = np.flatnonzero(final == kind)
                if len(some):
                    for made in _piece_rows(raw, buckets, kind, columns, start, some, width):
                        yield _batch(made, _PIECES, _PIECE_KINDS)

        for batch in batches:
            for row in batch.to_pylist():
                raw, ends = np.frombuffer(_unzip(row["texts"]), np.uint8), np.cumsum(row["sizes"])
                if texts and size + len(raw) > text:
                    yield from out()
                    n = size = 0
                texts.append(raw)
                ids = np.array([_NONE if x is None else x for x in row["ids"]], np.int64)
                known = np.concatenate([_array(x, "<u8") for x in row["found"]])
                total = np.concatenate([_array(x, "<u8") for x in row["totals"]]).astype(np.int64)
                order = np.argsort(known)
                known, total = known[order], total[order]
                begins = ends - row["sizes"]
                for anchor, owner, first, count in _segments(raw, ends, width, gram, 1 << 16):
                    order = np.argsort(anchor)
                    at = np.minimum(np.searchsorted(known, anchor[order]), len(known) - 1)
                    some = known[at] == anchor[order]
                    if not some.any():
                        continue
                    order, times = order[some], total[at[some]]
                    anchor, owner, first, count = anchor[order], owner[order], first[order], count[order]
                    doc, owner, count = ids[owner], owner.astype(np.int32), count.astype(np.uint8)
                    dealt = -(-times // hot)  # buckets of the anchor, one unless it is hot
                    salt = (mix(doc.astype(np.uint64) + _ODD) % dealt.astype(np.uint64)) * (dealt > 1)
                    held.append((dealt == 1, first + size, mix(anchor + salt * _ODD), doc, np.full(len(doc), row["block"], np.int64), first - begins[owner], owner, count))
                    n += len(doc)
                    if n >= most:
                        yield from out()
                        texts.append(raw)
                        n = size = 0
                size += len(raw)
        if held:
            yield from out()

    return run


def _first_documents(raw: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string the least document that has it, and where a string's windows begin in that."""
    lengths = count + width - 1
    transform, common = build(raw, start, lengths, width)
    place, string, size = suffix_places(transform, lengths, width)
    order = np.argsort(place)
    place, string, size = place[order], string[order], size[order]
    new = common[place] < width
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[string], np.flatnonzero(new))[group] if len(new) else np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    out[begin[string] + lengths[string] - size] = least
    return out, begin


def _distinct_strings(data: bytes, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One member of each set of equal strings, the set of every string, and the sets' least documents. Equal by bytes."""
    names: dict[bytes, int] = {}
    of = np.array([names.setdefault(data[s : s + n], len(names)) for s, n in zip(start.tolist(), length.tolist(), strict=True)], np.int64)
    one = np.zeros(len(names), np.int64)
    one[of[::-1]] = np.arange(len(of))[::-1]
    least = np.full(len(names), _NONE, np.int64)
    np.minimum.at(least, of, doc)
    return one, of, least


def _window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place."""
    gram, out = width - width % 8, np.empty(len(raw) - width + 1, np.uint64)
    for lo in range(0, len(out), _SLICE):
        h = _gram_hashes(raw[lo : lo + _SLICE + width - 1], gram)
        out[lo : lo + _SLICE] = mix(h[: len(h) - (width - gram)] * _ODD + h[width - gram :])
    return out


def _shared_stretches(raw: np.ndarray, start: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings with a window whose hash another string has too, and the first and last such window of each.

    No other window of theirs stands in two strings; whether these do is for the transform to say.
    """
    string = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    window = np.arange(len(string)) - begin[string]
    h = _window_hashes(_gather(raw, start, count + width - 1), width)[window + (begin + np.arange(len(count)) * (width - 1))[string]]
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1])
    s, edge = string[order], np.flatnonzero(new)
    some = np.zeros(len(h), bool)
    some[order] = (np.minimum.reduceat(s, edge) != np.maximum.reduceat(s, edge))[np.cumsum(new) - 1]
    at = np.flatnonzero(some)
    s = string[at]
    new = s[1:] != s[:-1]
    return s[np.append(True, new)[: len(s)]], window[at[np.append(True, new)[: len(s)]]], window[at[np.append(new, True)[: len(s)]]]


def _gone(data: bytes, raw: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of all pieces whether a smaller document has them, and their pieces and numbers there."""
    one, of, least = _distinct_strings(data, start, count + width - 1, doc)
    before, begin = np.repeat(least, count[one]), np.cumsum(count[one]) - count[one]
    _, which, strings = np.unique(anchor[one], return_inverse=True, return_counts=True)
    met = np.flatnonzero(strings[which] > 1)  # a string that is alone with its anchor shares no window
    if len(met):
        some, lo, hi = _shared_stretches(raw, start[one][met], count[one][met], width)
        met, k = met[some], hi - lo + 1
        found, _ = _first_documents(raw, start[one][met] + lo, k, least[met], width)
        before[np.repeat(begin[met] + lo - np.cumsum(k) + k, k) + np.arange(len(found))] = found
    piece = np.repeat(np.arange(len(doc)), count)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    return before[begin[of[piece]] + window] < doc[piece], piece, window


def _found_spans(width: int, buckets: int, most: int, hot_pass: bool, held: int = 1 << 18):
    """Bucket of pieces -> (block, spans) and, of hot anchors, the windows that no document of the bucket has before.

    A bucket is gone through in parts of about ``most`` pieces, each with all pieces of its anchors. Spans and windows of a task's
    buckets leave together, when there are ``held``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple] = []
        left: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            made = []
            if spans:
                block, *columns = (np.concatenate(x) for x in zip(*spans, strict=True))
                order = np.argsort(block, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
                    made.append((None, int(block[at[0]]), None, len(at), _zip(b"".join(c[at].astype(k).tobytes() for c, k in zip(columns, _SPAN, strict=True)))))
            if left:
                text, *columns = (np.concatenate(x) for x in zip(*left, strict=True))
                start = np.arange(len(text) // width) * width
                for rows in _piece_rows(text, buckets, True, [*columns, np.ones(len(start), np.uint8)], start, np.arange(len(start)), width):
                    made += [(bucket, None, *rest) for bucket, *rest in rows]
            spans.clear()
            left.clear()
            for lo in range(0, len(made), 1 << 9):
                yield _batch(made[lo : lo + (1 << 9)], _SPANS, _SPAN_KINDS)

        for rows in _runs(batches):
            final = np.repeat([r["final"] for r in rows], [r["n"] for r in rows])
            columns, texts = zip(*(_unpack(r["pieces"], r["n"]) for r in rows), strict=True)
            rows.clear()
            anchor, doc, block, first, owner, count = (np.concatenate(x) for x in zip(*columns, strict=True))
            data, count = b"".join(texts), count.astype(np.int64)
            del columns, texts
            raw = np.frombuffer(data, np.uint8)
            start = np.cumsum(count + width - 1) - (count + width - 1)
            part = (mix(anchor ^ _ODD) % np.uint64(-(-len(anchor) // most))).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                gone, piece, window = _gone(data, raw, start[at], count[at], doc[at], anchor[at], width)
                edge = np.flatnonzero(gone)
                opens = edge[(window[edge] == 0) | ~gone[edge - 1]]
                closes = edge[(window[edge] == count[at][piece[edge]] - 1) | ~gone[np.minimum(edge + 1, len(gone) - 1)]]
                i = at[piece[opens]]
                spans.append((block[i], owner[i], first[i] + window[opens], first[i] + window[closes] + width))
                stays = np.flatnonzero(~gone & ~final[at][piece]) if hot_pass and not final[at].all() else edge[:0]
                for lo in range(0, len(stays), held):
                    i, w = at[piece[stays[lo : lo + held]]], window[stays[lo : lo + held]]
                    text = _gather(raw, start[i] + w, np.full(len(i), width))
                    left.append((text, _content(text, width), doc[i], block[i], first[i] + w, owner[i]))
                    if sum(len(x[1]) for x in left) >= held:
                        yield from out()
                if sum(len(x[0]) for x in spans) >= held:
                    yield from out()
        yield from out()

    return run


def _content(text: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that ``text`` holds one after the other."""
    h = np.zeros(len(text) // width, np.uint64)
    for column in text.reshape(-1, width).T:
        h = mix(h * _ODD + column.astype(np.uint64) + np.uint64(1))
    return h


_SPAN = ("<i4", "<i8", "<i8")
_SPANS = ("bucket", "block", "final", "n", "pieces")
_SPAN_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
_SPAN_SCHEMA = "bucket long, block long, final boolean, n int, pieces binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block with its spans -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for batch in batches:
        for row in batch.to_pylist():
            held = [(_unzip(x["pieces"]), x["n"]) for x in row["spans"] or ()]
            owner = np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(x, "<i4", n) for x, n in held)])
            a, z = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<i8", n, at * n) for x, n in held)]) for at in (4, 12))
            sizes = np.array(row["sizes"], np.int64)
            begins = np.cumsum(sizes) - sizes
            a, z = a + begins[owner], z + begins[owner]
            order = np.argsort(a, kind="stable")
            owner, a, z = owner[order], a[order], np.maximum.accumulate(z[order])  # no span passes the end of its text
            new = np.append(True, (a[1:] > z[:-1]) | (owner[1:] != owner[:-1]))[: len(a)]
            owner, begin, end = owner[new], a[new], z[np.append(new[1:], True)[: len(a)]]
            cut = np.searchsorted(owner, np.arange(len(sizes) + 1)).tolist()
            gone = np.append(0, np.cumsum(end - begin))[cut]
            gone = (gone[1:] - gone[:-1]).tolist()
            spans, places = list(zip(begin.tolist(), end.tolist(), strict=True)), begins.tolist()
            text, out = memoryview(_unzip(row["texts"])), []
            for i, (doc, size) in enumerate(zip(row["ids"], row["sizes"], strict=True)):
                own, at = spans[cut[i] : cut[i + 1]], places[i]
                kept, done = hashlib.sha256(), at
                for b, e in own:
                    kept.update(text[done:b])
                    done = e
                kept.update(text[done : at + size])
                out.append((doc, size, gone[i], len(own), kept.hexdigest(), [{"start": b - at, "end": e - at} for b, e in own]))
            yield _batch(out, tuple(names), tuple(kinds))


def suffix_dedup(docs: DataFrame, width: int = 50, gram: int = 24, block: int = 4 << 20, bucket: int = 40_000, hot: int = 20_000, anchors: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes from, up to) of every row.

    ``anchors`` and ``bucket`` are the anchors and, but for a factor of two, the pieces that a task holds at a time; ``hot`` is the number of documents beyond which
    an anchor is dealt to several buckets.
    """
    if gram % 8 or not 8 <= gram <= width or width > 200:
        raise ValueError("gram is a multiple of eight, up to width, and width at most 200")
    held = settle(blocks(docs, block), "blocks")
    size = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, math.ceil(size * 2 / (width - gram + 2) / anchors))
    found = held.mapInArrow(_anchor_rows(width, gram, parts), "bucket int, block long, n int, anchors binary")
    back = found.repartition(min(parts, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "block long, anchors binary, totals binary, n long")
    repeated = settle(back, "repeated-anchors")
    n = repeated.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(n / bucket / 2))
    lists = repeated.groupBy("block").agg(F.collect_list(F.struct("anchors", "totals")).alias("lists"))
    meeting = held.join(lists.hint("shuffle_hash"), "block").select("block", "ids", "sizes", "texts", F.col("lists.anchors").alias("found"), F.col("lists.totals").alias("totals"))
    sent = meeting.mapInArrow(_sent_pieces(width, gram, buckets, hot), _PIECE_SCHEMA)
    tasks = min(buckets, max(16, math.ceil(buckets / 4)), 20_000)
    spans = settle(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_found_spans(width, buckets, bucket, True), _SPAN_SCHEMA), "spans")
    again = spans.where("bucket is not null").select("bucket", "final", "n", "pieces").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    more = settle(again.mapInArrow(_found_spans(width, buckets, bucket, False), _SPAN_SCHEMA), "more-spans")
    discard(repeated)
    every = spans.where("bucket is null").unionByName(more)
    by_block = every.groupBy("block").agg(F.collect_list(F.struct("n", "pieces")).alias("spans"))
    met = held.join(by_block.hint("shuffle_hash"), "block", "left").select("ids", "sizes", "texts", "spans")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return met.mapInArrow(_removed, kind).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
