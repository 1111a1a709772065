"""Token counts with a sentencepiece model, huge documents in overlapping chunks.

A text longer than ``chunk`` bytes is encoded in chunks that overlap. Two neighbours are
spliced at a boundary that lies in their overlap, that both encodings have, and that is proven
stable: no piece of the vocabulary holds the two characters around it side by side (the pairs are
collected when the model is loaded), so no merge crosses such a place and what stands on either side
is encoded alike with or without the other. One of such places is before a blank that follows something
else, but texts without blanks, in any script, have them too. Characters that the model's normalisation could change or join, and
two unknown characters in a row, which the library makes one token, prove nothing. Without such a boundary the overlap is widened, up to the whole text.

Defined results: null counts as empty (0 bytes, 0 tokens); rows that repeat are counted each; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

_BLANK = "▁"


class Seams:
    """Where no token of a model can lie across two characters, whatever stands around them."""

    def __init__(self, pieces: list[str]):
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known = set("".join(pieces))
        self.before_blank = not any(p[1] == _BLANK != p[0] for p in self.pairs)

    def between(self, before: str, after: str) -> bool:
        if after == " ":
            return self.before_blank and before.isprintable() and before not in (" ", _BLANK)
        both = before + after
        plain = both.isprintable() and " " not in both and _BLANK not in both and unicodedata.normalize("NFKC", both) == both
        return plain and both not in self.pairs and (before in self.known or after in self.known)


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Any, Seams]:
    """The model and its seams."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, Seams([model.id_to_piece(i) for i in range(model.get_piece_size())])


def boundaries(model: Any, raw: bytes, a: int, z: int) -> np.ndarray:
    """First byte of every token of ``raw[a:z]``."""
    return np.array([p.begin for p in model.encode(raw[a:z].decode(), return_type="proto").pieces], np.int64) + a


def count_long(model: Any, seams: Seams, raw: bytes, chunk: int, overlap: int) -> int:
    """Tokens of the UTF-8 text ``raw`` by overlapping chunks; ``raw[done:]`` is still to count."""

    def char_start(i: int) -> int:
        while i < len(raw) and raw[i] & 0xC0 == 0x80:
            i -= 1
        return i

    def proven(p: int) -> bool:
        return seams.between(raw[char_start(p - 1) : p].decode(), raw[p : p + 4].decode(errors="ignore")[0])

    total, done, a = 0, 0, 0
    end = char_start(min(chunk, len(raw)))
    left = boundaries(model, raw, a, end)
    while end < len(raw):
        width, splice = overlap, None
        while splice is None and (b := char_start(max(end - width, 0))) > done:
            stop = char_start(min(b + max(chunk, 2 * width), len(raw)))
            right = boundaries(model, raw, b, stop)
            both = np.intersect1d(left, right)
            splice = next((int(p) for p in both[(both > b) & (both < end)] if proven(p)), None)
            width *= 2
        if splice is None:  # nothing proven in the whole chunk: make it longer
            end = char_start(min(a + 2 * (end - a), len(raw)))
            left = boundaries(model, raw, a, end)
            continue
        total += int(((left >= done) & (left < splice)).sum())
        done, a, left, end = splice, b, right, stop
    return total + int((left >= done).sum())


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the model at ``path``."""
    bounded_batches(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seams = load(path)
        for batch in batches:
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            n = [
                count_long(model, seams, x.as_buffer().to_pybytes(), chunk, overlap) if z > chunk else len(model.encode_as_numpy(x.as_py()))
                for x, z in zip(batch.column(1), size.to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
