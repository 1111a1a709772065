"""Language identification by multilingual mixture inference.

Each learned language is a distribution over hashed byte trigrams of lower-cased letters (a word's
edges count as blanks). A word's likelihood in a language is the product of its trigrams'
likelihoods. A document is a mixture of languages, one to each word: expectation-maximisation
estimates the proportions, and the language set is the one of the nested sets (by proportion) with
the largest log-likelihood less ``penalty * log(words)`` for each language beyond the first. Sets
grow to all learned languages; only those are left out whose penalty alone is above the best found.

The model is fitted on at most about ``per_language`` documents of each language (by a hash of the
id, training folds only); the inference covers every whole text, all documents of a slice at once.
A text of over ``_SLICE`` bytes is read in slices of that size and kept as its distinct words with
their numbers, so its memory grows with these (some 50 bytes each), not with its length.

Defined results: null text and text without a letter are ``und`` with score 0; equal proportions go
to the language first in order; without training rows everything is ``und``; null ``lang`` rows are
not learned from; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, fold
from .textvec import _FOLD, LETTERS, text_bytes, text_slices

_BITS = 16
_BLANK = np.uint8(32)
_SLICE = 1 << 20


def _trigrams(raw: np.ndarray, offsets: np.ndarray, before: np.uint8 = _BLANK, after: np.uint8 = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each trigram, index of each word's first trigram, and words by row.

    A trigram belongs to the word that holds its last two bytes' first one; every byte of a word is
    the middle of one trigram. ``before`` and ``after`` are the bytes around, where ``raw`` is a
    slice of a text.
    """
    inside = LETTERS[raw]
    b = np.where(inside, _FOLD[raw], _BLANK)
    left = np.r_[_BLANK, b[:-1]] if len(b) else b
    right = np.r_[b[1:], _BLANK] if len(b) else b
    edge = offsets[:-1][offsets[:-1] < len(b)]
    left[edge] = _BLANK
    last = offsets[1:][offsets[1:] > 0] - 1
    right[last] = _BLANK
    if len(b):
        left[0], right[-1] = (_FOLD[x] if LETTERS[x] else _BLANK for x in (before, after))
    at = np.flatnonzero(inside)
    code = left[at].astype(np.uint32) << np.uint32(16) | b[at].astype(np.uint32) << np.uint32(8) | right[at]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
    firsts = np.flatnonzero(left[at] == _BLANK)
    return slot, firsts, np.diff(np.searchsorted(at[firsts], offsets))


def _slices(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Slots and first trigrams of one text, slice by slice, and whether the last word goes on in the next slice."""
    for lo in range(0, len(raw), _SLICE):
        hi = min(lo + _SLICE, len(raw))
        before, after = raw[lo - 1] if lo else _BLANK, raw[hi] if hi < len(raw) else _BLANK
        slot, firsts, _ = _trigrams(raw[lo:hi], np.array([0, hi - lo]), before, after)
        yield slot, firsts, bool(LETTERS[raw[hi - 1]] and LETTERS[after])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of a task's rows (lang, text)."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for i, lang in enumerate(batch.column(0).to_pylist()):
            own = counts.setdefault(lang, np.zeros(1 << _BITS, np.int64))
            for slot, _, _ in _slices(text_bytes(batch.column(1).slice(i, 1))[0]):
                np.add.at(own, slot, 1)
    for lang, own in counts.items():
        slot = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot), pa.array(own[slot])], ["lang", "slot", "n"])


def train(docs: DataFrame, per_language: int = 2000, languages: int = 64) -> tuple[list[str], np.ndarray] | None:
    """The languages in order and their log-likelihoods, a row for each slot.

    The ``languages`` values of ``lang`` with the most documents are learned (ties in order of the value), so a column with
    thousands of values takes 64 x 2**16 numbers in a task and in the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    most = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    rows = rows.where(F.col("lang").isin(most))
    sample = bounded_sample(rows.select("doc_id", "lang", "text"), "lang", "doc_id", per_language)
    by_slot = sample.select("lang", "text").mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = by_slot.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("n")).orderBy("lang").collect()  # 2**16 slots a language
    if not found:
        return None
    counts = np.full((1 << _BITS, len(found)), 0.5)
    for i, r in enumerate(found):
        counts[r["slots"], i] += r["n"]
    return [r["lang"] for r in found], np.log(counts / counts.sum(0)).astype(np.float32)


def _mixture(
    like: np.ndarray, times: np.ndarray, row: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``steps`` rounds and the log-likelihood under them, by row. A word counts ``times``."""
    for _ in range(steps):
        r = like * share[row]
        r *= (times / r.sum(1))[:, None]
        share = np.add.reduceat(r, starts, 0) / n[:, None]
    return share, np.add.reduceat(times * np.log((like * share[row]).sum(1) + 1e-30), starts)


def _choose(ll: np.ndarray, times: np.ndarray, words: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Proportions of the chosen set of each row, from its words' log-likelihoods (row after row, ``words`` of them, one at least)."""
    n_rows, n_lang = len(words), ll.shape[1]
    like = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -12)).astype(np.float32)
    starts, row = np.cumsum(words) - words, np.repeat(np.arange(n_rows), words)
    n = np.add.reduceat(times, starts)
    whole, _ = _mixture(like, times, row, starts, n, np.full((n_rows, n_lang), 1 / n_lang, np.float32), steps)
    order = np.argsort(-whole, 1, kind="stable")
    best = np.full(n_rows, -np.inf)
    chosen = np.zeros_like(whole)
    for k in range(1, n_lang + 1):
        cost = penalty * np.log(n + 1) * (k - 1)
        left = np.flatnonzero(-cost > best)  # a fit is at most 0
        if not len(left):
            break
        if len(left) < n_rows:
            keep = np.isin(row, left)
            word, seen = like[keep], times[keep]
            starts, at = np.cumsum(words[left]) - words[left], np.repeat(np.arange(len(left)), words[left])
        else:
            word, seen, at = like, times, row
        allowed = np.zeros((len(left), n_lang), np.float32)
        np.put_along_axis(allowed, order[left, :k], 1, 1)
        share, fit = _mixture(word, seen, at, starts, n[left], allowed / k, 0 if k == 1 else steps)
        better = fit - cost[left] > best[left]
        best[left[better]], chosen[left[better]] = (fit - cost[left])[better], share[better]
    return chosen


def _distinct_words(raw: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of the distinct words of a long text and how often each stands, from slices.

    Words are told apart by a sum of random numbers, one for each trigram slot, which is all that
    their likelihood depends on. A word that goes on in the next slice is carried over.
    """
    by = np.random.default_rng(3).integers(0, 1 << 63, 1 << _BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys, lls, times = np.zeros(0, np.uint64), np.zeros((0, model.shape[1]), np.float32), np.zeros(0, np.float32)
    open_key, open_ll, is_open = np.zeros(1, np.uint64), np.zeros((1, model.shape[1]), np.float32), False
    for slot, firsts, goes_on in _slices(raw):
        if is_open:
            firsts = np.r_[0, firsts]  # the rest of the open word
        if not len(slot):
            continue
        key, ll = np.add.reduceat(by[slot], firsts), np.add.reduceat(model[slot], firsts, 0)
        if is_open:
            key[:1] += open_key
            ll[:1] += open_ll
        is_open = goes_on
        if is_open:
            open_key, open_ll, key, ll = key[-1:], ll[-1:], key[:-1], ll[:-1]
        keys, first, place = np.unique(np.r_[keys, key], return_index=True, return_inverse=True)
        lls = np.concatenate([lls, ll])[first]
        times = np.bincount(place, np.r_[times, np.ones(len(key), np.float32)], len(keys)).astype(np.float32)
    return lls, times


def infer(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray, penalty: float = 2.0, steps: int = 6) -> np.ndarray:
    """Language proportions (rows x languages) of the chosen set; zeros for rows without words."""
    out = np.zeros((len(offsets) - 1, model.shape[1]), np.float32)
    if len(out) == 1 and len(raw) > _SLICE:
        ll, times = _distinct_words(raw, model)
        if len(ll):
            out[:] = _choose(ll, times, np.array([len(ll)]), penalty, steps)
        return out
    slot, firsts, words = _trigrams(raw, offsets)
    some = np.flatnonzero(words)
    if len(some):
        ll = np.add.reduceat(model[slot], firsts, 0)
        out[some] = _choose(ll, np.ones(len(ll), np.float32), words[some], penalty, steps)
    return out


def detect_language(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """doc_id, lang_pred, score, langs (the chosen set with its proportions) of every row."""
    bounded_batches(docs)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select("doc_id", has_letter, F.coalesce("text", F.lit("")).alias("text"))
    names, weights = model or (["und"], np.zeros((1 << _BITS, 1), np.float32))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            parts = [infer(*text_bytes(text.slice(lo, hi - lo)), weights) for lo, hi in text_slices(text, _SLICE)]
            share = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.float32)
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            top = share.argmax(1)
            pred = [names[i] if ok else "und" for i, ok in zip(top, letters, strict=True)]
            score = np.where(letters, np.clip(share.max(1), 0, 1), 0).astype(np.float64)
            langs = [[{"lang": names[i], "share": float(s[i])} for i in np.flatnonzero(s)] if ok else [] for s, ok in zip(share, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                ["doc_id", "lang_pred", "score", "langs"],
            )

    return rows.mapInArrow(detect, f"doc_id {kind}, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs of every document."""
    found = detect_language(docs, train(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "langs")
