"""Packing by power-of-two decomposition.

A document's ids (the tokenizer's, then ``end_id``) are cut into the binary digits of their number:
as many pieces of ``size`` as fit, then one piece for each further digit, longest first. Every piece
is a sequence of its own in the bucket of its length, so no sequence crosses documents and none is
padded: a batch is drawn from one bucket.

Ids are those of the ``tokenizers`` library. A text is cut before each white-space byte that a
visible character follows. The byte-level pattern always starts a pre-token there (of a run of
white space the last one stands apart), so what lies between two cuts has the same ids wherever it
stands: it is encoded once per task and kept with its bytes (the table is emptied at ``keep``
entries). That no token crosses a cut is checked whenever stretches are encoded, and the bytes of
every stretch are compared with those kept; rows whose stretches differ are encoded whole.

Defined results: null text counts as empty and packs as the end id alone; a text may begin and end
in any white space, whatever the next row begins with; rows that repeat are packed each, with
sequence ids of their own; sequence ids are unique and repeat when a task is run again over the same
input; an empty table gives an empty result; further columns are not read. A long text is encoded in
pieces of about 1 MB that end at cuts or, where it has none for as long, between two letters of a run that no
token can join there (every token that holds both is compared with the text around them). Only a text that has
neither, as one of punctuation alone, is encoded in a longer piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textvec import mix, powers, text_bytes, text_slices

#: Bytes before which a pre-token may start: blank, newline, tab, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 10, 9, 13]] = True
#: First bytes of characters that are no white space: visible ASCII and most of what lies beyond.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xE1] = _VISIBLE[0xE4:0xF5] = True


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Any, np.ndarray, np.ndarray, frozenset[bytes], tuple[bytes, ...]]:
    """An encoder with the vocabulary of a byte-level ``tokenizers`` file, the length of every id, the bytes that end a run at a cut, the tokens and the special strings.

    A special string is taken out of the text first, so white space before it is a run of its own:
    there is no cut before what special strings begin with.

    The file's ids are its merge ranks, so the ranks are read from its vocabulary. The faster
    library gives the ids that ``tokenizers`` gives; that is asserted here on a few strings and
    tested on whole tables.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    special = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model.get_vocab(with_added_tokens=False).items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    tokens = frozenset(ranks)
    for text in ("ab cd.\n ef  g\n\nh's é", *special):
        if fast.encode(text, allowed_special="all") != model.encode(text, add_special_tokens=False).ids:
            raise ValueError("the vocabulary is not one of ranks")
    sizes = np.zeros(model.get_vocab_size(), np.int64)
    for token, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
        sizes[i] = len(token)
    visible = _VISIBLE.copy()
    visible[[k.encode()[0] for k in special]] = False
    return fast, sizes, visible, tokens, tuple(k.encode() for k in special)


class Encoder:
    """Ids of texts, with recurring stretches and their ids kept by the stretches' 64-bit hashes."""

    def __init__(self, path: str, keep: int = 1_000_000):
        (self.model, self.token_bytes, self.visible, self.tokens, self.special), self.keep = load(path), keep
        self.longest = max(map(len, self.tokens))
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes, self.places, self.lengths = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _ids(self, raw: bytes) -> np.ndarray:
        return self.model.encode_to_numpy(raw.decode(), allowed_special="all")

    def _learn(self, hashes: np.ndarray, joined: list[np.ndarray], alone: list[np.ndarray]) -> None:
        """Add stretches: ``joined`` begin with white space and are encoded in one go, ``alone`` one by one."""
        parts = [*joined, *alone]
        lengths = np.array([len(p) for p in parts], np.int64)
        ids = self._ids(b"".join(p.tobytes() for p in joined))
        ends = np.cumsum(lengths[: len(joined)])
        token_ends = np.cumsum(self.token_bytes[ids])
        z = np.searchsorted(token_ends, ends) + 1
        if len(joined) and not np.array_equal(token_ends[z - 1], ends):
            raise ValueError("a token crosses a cut")
        single = [self._ids(x.tobytes()) for x in alone]
        sizes = np.r_[np.diff(z, prepend=0), [len(x) for x in single]].astype(np.int64)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        places = len(self.bytes) + np.cumsum(lengths) - lengths
        self.ids, self.bytes = np.concatenate([self.ids, ids, *single]), np.concatenate([self.bytes, *parts])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        for name, new in (("hashes", hashes), ("starts", starts), ("sizes", sizes), ("places", places), ("lengths", lengths)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))

    def seam(self, raw: np.ndarray, lo: int, hi: int) -> int | None:
        """The last place in ``raw[lo:hi]`` between two letters that no token can join, with letters alone just before."""
        for p in range(hi - 1, lo + 4, -1):
            if raw[p] & 0xC0 == 0x80:
                continue
            left, right = raw[max(0, p - self.longest) : p].tobytes(), raw[p : p + self.longest].tobytes()
            if not (left[-16:].decode(errors="ignore")[-4:] + right[:4].decode(errors="ignore")[:1]).isalpha():  # no contraction begins there
                continue
            if any(left[-i:] + right[:j] in self.tokens for i in range(1, len(left) + 1) for j in range(1, min(len(right), self.longest - i) + 1)):
                continue
            if not any(s in raw[max(0, p - len(s) + 1) : p + len(s) - 1].tobytes() for s in self.special):
                return p
        return None

    def encode(self, raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and how many each row has. A row of over ``most`` bytes goes in pieces that end at cuts."""
        if len(offsets) == 2 and len(raw) > most:
            ids, lo, alone = [], 0, True
            while lo < len(raw):
                hi, cuts, seam = lo, np.zeros(0, np.int64), None
                while not len(cuts) and seam is None and hi < len(raw):  # farther where there is no cut so far
                    hi, before = min(hi + most, len(raw)), hi
                    if hi < len(raw):
                        cuts = np.flatnonzero(_SPACE[raw[lo + 1 : hi]] & self.visible[raw[lo + 2 : hi + 1]])
                        seam = None if len(cuts) else self.seam(raw, max(before, hi - (1 << 14)), hi)
                hi = lo + 1 + int(cuts[-1]) if len(cuts) else hi if seam is None else seam
                ids.append(self._encode(raw[lo:hi], np.array([0, hi - lo]), alone)[0])
                lo, alone = hi, not len(cuts)
            ids = np.concatenate(ids)
            return ids, np.array([len(ids)])
        return self._encode(raw, offsets, True)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        some = np.diff(offsets) > 0
        tops = offsets[:-1][some]
        cut = np.zeros(len(raw), bool)
        cut[:-1] = _SPACE[raw[:-1]] & self.visible[raw[1:]]
        cut[offsets[1:][some] - 1] = False  # what follows a row's last byte is another text
        cut[tops] = True
        own = np.zeros(len(raw), bool)
        own[tops] = whole  # what a text begins with has no cut before it
        s = np.flatnonzero(cut)
        e = np.r_[s[1:], len(raw)]
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x100000001B3)) ^ own[s].astype(np.uint64)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > self.keep:
            self._clear()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            top = own[s[first[new]]]
            joined, single = new[~top], new[top]
            self._learn(np.r_[distinct[joined], distinct[single]], *([raw[s[i] : e[i]] for i in first[x]] for x in (joined, single)))
            at = np.searchsorted(self.hashes, distinct)
        at = at[inverse]
        lengths = self.lengths[at]
        if not np.array_equal(lengths, e - s) or not np.array_equal(self.bytes[np.arange(len(raw)) + np.repeat(self.places[at] - s, lengths)], raw):
            every = [self._ids(raw[a:z].tobytes()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]  # two stretches with one hash
            return np.concatenate(every), np.array([len(x) for x in every])
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1])) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        by_row = np.r_[0, ends][np.searchsorted(s, offsets)]
        return self.ids[index], np.diff(by_row)


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, longest first."""
    return [size] * (n // size) + [1 << k for k in range(size.bit_length() - 2, -1, -1) if (n % size) >> k & 1]


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    bounded_batches(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                keys, start, length, crc, total, flat = [], [], [], [], [], []
                every, counts = encoder.encode(*text_bytes(part.column(1)))
                for i, ids in enumerate(np.split(every, np.cumsum(counts)[:-1])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    flat.append(ids)
                    view, at = memoryview(ids).cast("B"), 0
                    for n in cut(len(ids), size):
                        keys.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                        total.append(len(ids))
                        at += n
                n = len(keys)
                offsets = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keys, pa.int64())),
                        *(pa.array(x, pa.int64()) for x in (start, length)),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat).astype(np.int32))),
                        *(pa.array(x, pa.int64()) for x in (crc, total)),
                        pa.array(np.arange(made, made + n)),
                        pa.array(np.zeros(n, np.int64)),
                    ],
                    ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                made += n

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def buckets(pieces: DataFrame, spread: int = 64) -> DataFrame:
    """Pieces grouped by length for training: equal lengths together, each length over up to ``spread`` tasks."""
    return pieces.repartition("length", F.pmod(F.xxhash64("sequence_id"), F.lit(spread))).sortWithinPartitions("length", "sequence_id")
