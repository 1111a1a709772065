"""Exact deduplication with counting quotient filters.

1. One pass gives every row the SHA-256 of its normalised text (A-Z lower-cased, nothing else;
   null counts as empty) and a 64-bit fingerprint.
2. Every partition builds counting quotient filters of its fingerprints, one for each block of the
   fingerprint space; the filters of a block merge by sorted remainders. A hot fingerprint is one
   slot with a count in every filter, so it moves no rows.
3. Rows whose fingerprint has a count above one go to byte verification: they are grouped by the
   normalised text itself, with partial aggregation before the shuffle.

Defined results: null and empty texts are equal; of equal texts the largest ``doc_id`` stays; rows
that repeat one ``doc_id`` with one text stay or go together; null ids lose against any id, and a
group of null ids alone is kept; an empty table gives an empty result. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, semi_join, settle
from .quotient_filter import add_up, merge, pack
from .textvec import _FOLD, text_bytes, text_slices


def _folded(column: pa.Array) -> pa.Array:
    """The column with A-Z lower-cased, bytes beyond ASCII untouched."""
    raw, offsets = text_bytes(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(_FOLD[raw].tobytes()))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = []
        for lo, hi in text_slices(batch.column(1)):
            raw, offsets = text_bytes(batch.column(1).slice(lo, hi - lo))
            low = memoryview(_FOLD[raw])
            sha += [hashlib.sha256(low[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        fp = np.frombuffer(b"".join(h.digest()[:8] for h in sha), "<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array([h.hexdigest() for h in sha], pa.string())], ["doc_id", "fp", "sha"])


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_slices(batch.column(1), 16 << 20):
            part = batch.slice(lo, hi - lo)
            text = _folded(part.column(1))
            raw, offsets = text_bytes(text)
            view = memoryview(raw)
            fp = b"".join(hashlib.sha256(view[a:b]).digest()[:8] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.frombuffer(fp, "<i8")), text.cast(pa.string())], ["doc_id", "fp", "norm"])


def repeated_fingerprints(fps: DataFrame, block_bits: int = 11, flush: int = 1 << 20) -> DataFrame:
    """(fp, n) of the fingerprints of column ``fp`` (long) that occur more than once.

    A partition packs its filters whenever ``flush`` fingerprints have come together.
    """
    bits = 64 - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            f = np.concatenate(parts)
            f, c = add_up(f, np.ones(len(f), np.uint64))
            blocks = f >> np.uint64(bits)
            cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            low = f & np.uint64((1 << bits) - 1)
            slices = [pack(low[a:b], c[a:b], bits) for a, b in zip(cuts, [*cuts[1:], len(f)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blocks[cuts].astype(np.int32)), pa.array(slices, pa.binary())], ["block", "filter"])

        parts, n = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= flush:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        f, c = merge(list(group["filter"]))
        f = (f[c > 1] | (np.uint64(int(key[0])) << np.uint64(bits))).view(np.int64)
        return pd.DataFrame({"fp": f, "n": c[c > 1].astype(np.int64)})

    filters = fps.select("fp").mapInArrow(build, "block int, filter binary")
    return filters.groupBy("block").applyInPandas(merged, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Without ``block_bits`` the fingerprint space is cut so that a block has about 2**18 rows, and into 2**11 blocks at least.
    """
    bounded_batches(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = settle(rows.mapInArrow(_digest, f"doc_id {kind}, fp long, sha string"), "digests")
    if block_bits is None:
        block_bits = max(11, (digests.count() >> 18).bit_length())
    repeated = settle(repeated_fingerprints(digests, block_bits), "repeated")
    normal = rows.mapInArrow(_normalise, f"doc_id {kind}, fp long, norm string")
    groups = (
        semi_join(normal, repeated.select("fp"), ["fp"])
        .groupBy("norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
    )
    alone = F.col("group_size").isNull()
    return digests.join(groups, "sha", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
