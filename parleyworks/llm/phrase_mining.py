r"""Collocations by vertical partitioning of a corpus' word suffixes.

A suffix is what follows from a word to the end of its piece, cut at ``longest`` words. Suffixes with one prefix form a subtree, which
can be built without the others. The prefixes start with two words and are counted over all texts; one that stands on more than
``budget`` suffixes is extended by a word and counted again, until none is above the budget or the depth is reached. Prefixes
are dealt to groups of about ``budget`` suffixes. A group's suffixes meet in one task, in sorted order; a node of its subtree at depth d is a run of suffixes that
share d words, and its count is the total of the leaves below. A node above an extended prefix spans groups, so its partial totals are added up.

Phrases below ``least`` occurrences lie in none above it, so suffixes end before a word or a pair below it. Which
words and pairs these are, tasks learn from two Bloom filters. A filter has at most ``filter_bits`` bits; beyond what it can hold it lets
more suffixes through, which are counted and dropped later, so it changes the work and never a result. Prefixes above the
budget are at most ``tokens / budget``, and the budget grows with the tokens so that these are at most 131,072.

Words travel as 64-bit hashes of language and word, and equal suffixes of a task once with their number, so a phrase or word of any
frequency is one row from each task. Two of the frequent words share a hash with a probability of about their square / 2**65.

Words are compared with A-Z lower-cased. Scores are exact decimals. Defined results: null text has no words; null lang is ``und``,
together with the rows that say ``und``; rows that repeat count again; ties go by score, count and phrase in byte order, cuts with equal scores to the shortest
first part; an empty table gives an empty result; further columns are not read. A very long text takes about twelve bytes a word in its task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settle
from .suffix_dedup import _batch, _runs, _unzip, _zip
from .textvec import _FOLD, mix, text_bytes, text_slices, word_hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


class Tokens:
    """The words of some rows: hash with the language, first byte, row, and whether a word follows the one before it in a piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.raw, self.ends = text_bytes(texts)
        h, self.first, counts = word_hashes(self.raw, self.ends, _WORD)
        self.row = np.repeat(np.arange(len(texts)), counts)
        names = langs.to_pylist()
        salt = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(names)}
        h = mix(h + np.array([salt[x] for x in names], np.uint64)[self.row])
        self.hash = np.where(h == 0, np.uint64(1), h)
        breaks = np.cumsum(_BREAK[self.raw], dtype=np.int64)[self.first] if len(self.first) else self.first
        self.joined = np.zeros(len(h), bool)
        self.joined[1:] = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])


def _tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, Tokens]]:
    for batch in batches:
        for lo, hi in text_slices(batch.column(1), size):
            langs = batch.column(0).slice(lo, hi - lo)
            yield langs, Tokens(langs, batch.column(1).slice(lo, hi - lo))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n), and of each lang a row without word and hash that has the number of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, t in _tokens(batches, 8 << 20):
            if not len(t.hash):
                continue
            h, one, n = np.unique(t.hash, return_index=True, return_counts=True)
            gaps = np.append(np.flatnonzero(~_WORD[t.raw]), len(t.raw))
            start = t.first[one]
            end = np.minimum(gaps[np.searchsorted(gaps, start)], t.ends[t.row[one] + 1])
            folded = _FOLD[t.raw].tobytes()
            words = [folded[a:z].decode() for a, z in zip(start.tolist(), end.tolist(), strict=True)]
            names = langs.to_pylist()
            of = [names[i] for i in t.row[one].tolist()]
            totals: dict[str, int] = {}
            for name, k in zip(names, np.bincount(t.row, minlength=len(names)).tolist(), strict=True):
                totals[name] = totals.get(name, 0) + k
            yield pa.RecordBatch.from_arrays(
                [pa.array(of + list(totals)), pa.array(words + [None] * len(totals), pa.string()), pa.array([*h.view(np.int64).tolist(), *[None] * len(totals)], pa.int64()), pa.array(n.tolist() + list(totals.values()), pa.int64())],
                ["lang", "word", "hash", "n"],
            )

    counted = docs.mapInArrow(run, "lang string, word string, hash long, n long")
    return counted.groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def bloom(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter of column ``hash`` with two hash functions, of 16 bits a row and at most ``most_bits`` bits, in words of 64."""
    n = hashes.count()
    bits = min(most_bits, max(1 << 10, 1 << math.ceil(math.log2(16 * n + 1))))
    second = F.shiftright("hash", 32)
    at = hashes.select(F.explode(F.array(F.pmod("hash", F.lit(bits)), F.pmod(second, F.lit(bits)))).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def _in(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the hashes."""
    bits = np.uint64(64 * len(filter_) - 1)
    found = np.ones(len(h), bool)
    for x in (h, (h.view(np.int64) >> 32).view(np.uint64)):
        at = x & bits
        found &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _is_one_of(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def _prefix_keys(h: np.ndarray, joined: np.ndarray, words: int) -> list[np.ndarray]:
    """For 1 to ``words`` words the hash of the phrase from each word, 0 where the piece ends before."""
    keys, ok = [h], np.ones(len(h), bool)
    for k in range(1, words):
        ok = ok & np.append(joined[k:], np.zeros(min(k, len(h)), bool))[: len(h)]
        further = np.append(h[k:], np.zeros(min(k, len(h)), np.uint64))[: len(h)]
        keys.append(np.where(ok, mix(keys[-1] * _ODD + further), np.uint64(0)))
    return keys


def count_prefixes(docs: DataFrame, words: np.ndarray, hot: list[np.ndarray], buckets: int, least: int) -> DataFrame:
    """(hash, n) of the prefixes of ``2 + len(hot)`` words that extend one of the last of ``hot``, of ``least`` occurrences or more."""
    depth = 2 + len(hot)
    known = docs.sparkSession.sparkContext.broadcast((words, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, above = known.value
        for _, t in _tokens(batches, 16 << 20):
            frequent = _in(filter_, t.hash)
            joined = t.joined & frequent & np.append(False, frequent[:-1])[: len(frequent)]
            keys = _prefix_keys(t.hash, joined, depth)
            take = keys[-1] != 0
            if above:
                take &= _is_one_of(above[-1], keys[-2])
            h, n = np.unique(keys[-1][take], return_counts=True)
            bucket = h >> np.uint64(40)  # ranges of equal width
            cuts = np.searchsorted(bucket, (np.arange(1, buckets) << 24) // buckets)
            parts = zip(np.split(h, cuts), np.split(n, cuts), strict=True)
            rows = [(b, _zip_sorted(x), _zip(c.astype("<u4"))) for b, (x, c) in enumerate(parts) if len(x)]
            if rows:
                yield _batch(rows, ("bucket", "keys", "counts"), (pa.int32(), pa.binary(), pa.binary()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            h = np.concatenate([_unzip_sorted(r["keys"]) for r in rows])
            n = np.concatenate([np.frombuffer(_unzip(r["counts"]), "<u4") for r in rows]).astype(np.int64)
            order = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            total = np.add.reduceat(n[order], new)
            some = total >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[order][new][some].view(np.int64)), pa.array(total[some])], ["hash", "n"])

    sent = docs.mapInArrow(run, "bucket int, keys binary, counts binary")
    return sent.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(add, "hash long, n long")


def _zip_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane."""
    steps = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return _zip(steps.view(np.uint8).reshape(-1, 8).T)


def _unzip_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _leaves(suffixes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in sorted order with their totals."""
    order = np.lexsort(suffixes.T[::-1])
    suffixes, n = suffixes[order], n[order]
    new = np.flatnonzero(np.append(True, (suffixes[1:] != suffixes[:-1]).any(1)))
    return suffixes[new], np.add.reduceat(n, new)


def nodes(suffixes: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth from two words: the nodes of the tree of the leaves as rows of word hashes, and the totals of their leaves."""
    shared = np.cumprod(suffixes[1:] == suffixes[:-1], axis=1).sum(1)  # words that a leaf shares with the one before
    for depth in range(2, suffixes.shape[1] + 1):
        deep = np.flatnonzero(suffixes[:, depth - 1] != 0)
        if not len(deep):
            return
        new = np.flatnonzero(np.append(True, (np.diff(deep) > 1) | (shared[deep[1:] - 1] < depth)))
        yield depth, suffixes[deep[new]], np.add.reduceat(n[deep], new)


def count_phrases(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, hot: list[np.ndarray], groups: int, least: int, longest: int) -> DataFrame:
    """(hashes, n) of the phrases of 2 to ``longest`` words and ``least`` occurrences, by one subtree for each prefix."""
    known = docs.sparkSession.sparkContext.broadcast((words, pairs, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_filter, pair_filter, above = known.value
        for _, t in _tokens(batches, 16 << 20):
            frequent = _in(word_filter, t.hash)
            joined = t.joined & frequent & np.append(False, frequent[:-1])[: len(frequent)]
            pair = _prefix_keys(t.hash, joined, 2)[1]
            some = (pair != 0) & _in(pair_filter, pair)
            if not some.any():
                continue
            joined[1:] &= some[:-1]
            at = np.flatnonzero(some)
            keys = [k[at] for k in _prefix_keys(t.hash, joined, longest)]
            padded = np.append(t.hash, np.zeros(longest, np.uint64))
            suffixes = np.stack([np.where(k != 0, padded[at + i], np.uint64(0)) for i, k in enumerate(keys)], axis=1)
            prefix = keys[1]
            for depth, big in enumerate(above, 2):
                above_budget = (prefix == keys[depth - 1]) & _is_one_of(big, prefix)
                prefix = np.where(above_budget & (keys[depth] != 0), keys[depth], prefix)
            group = (mix(prefix + np.uint64(7)) % np.uint64(groups)).astype(np.int64)
            name = group.astype(np.uint64)
            for column in suffixes.T:
                name = mix(name * _ODD + column)
            order = np.lexsort((name, group))
            s, g = suffixes[order], group[order]
            new = np.flatnonzero(np.append(True, (s[1:] != s[:-1]).any(1) | (g[1:] != g[:-1])))
            n = np.diff(np.append(new, len(s)))
            s, g = s[new], g[new]
            cuts = np.flatnonzero(np.diff(g)) + 1
            rows = [(int(g[a]), *_zip_suffixes(x), _zip(c.astype("<u4"))) for a, x, c in zip(np.append(0, cuts), np.split(s, cuts), np.split(n, cuts), strict=True)]
            yield _batch(rows, ("bucket", "sizes", "hashes", "counts"), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = known.value[2]
        for rows in _runs(batches):
            s = np.concatenate([_unzip_suffixes(r["sizes"], r["hashes"], longest) for r in rows])
            n = np.concatenate([np.frombuffer(_unzip(r["counts"]), "<u4") for r in rows]).astype(np.int64)
            for depth, found, total in nodes(*_leaves(s, n)):
                key = found[:, 0]
                for i in range(1, depth):
                    key = mix(key * _ODD + found[:, i])
                spread = _is_one_of(above[depth - 2], key) if depth - 2 < len(above) else np.zeros(len(key), bool)
                some = (total >= least) | spread
                ends = np.arange(0, (some.sum() + 1) * depth, depth, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(found[some, :depth]).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(total[some])], ["hashes", "n"])

    sent = docs.mapInArrow(run, "bucket int, sizes binary, hashes binary, counts binary")
    built = sent.repartition(min(groups, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(build, "hashes array<long>, n long")
    return built.groupBy("hashes").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _zip_suffixes(s: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of words, and the words one after the other."""
    there = s != 0
    return _zip(there.sum(1).astype("u1")), _zip(s[there].astype("<u8"))


def _unzip_suffixes(sizes: bytes, hashes: bytes, longest: int) -> np.ndarray:
    n = np.frombuffer(_unzip(sizes), "u1")
    out = np.zeros((len(n), longest), np.uint64)
    out[np.arange(longest) < n[:, None]] = np.frombuffer(_unzip(hashes), "<u8")
    return out


def _named(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, words, a) of (hashes, n)."""
    each = phrases.select("hashes", "n", F.posexplode("hashes").alias("i", "hash"))
    met = each.join(words.select("hash", "lang", "word"), "hash").groupBy("hashes").agg(F.first("n").alias("a"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    return met.select("lang", F.array_join("w.word", " ").alias("phrase"), F.col("w.word").alias("words"), "a")


def _part(first: Column, size: Column) -> Column:
    """``size`` of the words from number ``first``, which starts at 1, space-joined."""
    return F.array_join(F.slice("words", first, size), " ")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score: each phrase with its lowest-scoring cut."""
    counts = phrases.select("lang", "phrase", F.col("a").alias("f")).unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = "(1000BD * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r", "n")).alias("x")
    return phrases.join(cuts.groupBy("lang", "phrase").agg(lowest), ["lang", "phrase"]).select("lang", "phrase", "words", "a", "x.l", "x.r", "x.n", "x.score")


def _covered(phrases: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, longer): for phrases inside longer ones the largest count of these."""
    parts = [(i, k) for k in range(2, longest) for i in range(1, longest - k + 2)]
    inside = F.array(*(F.when(F.size("words") > F.greatest(F.lit(k), F.lit(i + k - 2)), _part(F.lit(i), F.lit(k))) for i, k in parts))
    rows = phrases.where(F.size("words") > 2).select("lang", F.explode(inside).alias("phrase"), "a").where("phrase is not null")
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def phrase_mining(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, budget: int = 1 << 20, filter_bits: int = 1 << 27) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each lang."""
    bounded_batches(docs, 16 << 20)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    counted = settle(count_words(rows).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    words, totals = counted.where("word is not null"), counted.where("word is null").select("lang", "n")
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, tokens >> 17)
    word_filter = bloom(words.select("hash"), filter_bits)
    buckets = max(1, math.ceil(tokens / (2 * budget)))
    pairs = settle(count_prefixes(rows, word_filter, [], buckets, least), "prefixes")
    hot, now = [], pairs
    while len(hot) < longest - 2:
        big = np.sort(now.where(F.col("n") > budget).select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        if not len(big):
            break
        hot.append(big)
        now = settle(count_prefixes(rows, word_filter, hot, buckets, budget + 1), "prefixes")
    groups = max(1, math.ceil((pairs.agg(F.sum("n")).first()[0] or 0) / budget))
    phrases = settle(count_phrases(rows, word_filter, bloom(pairs.select("hash"), filter_bits), hot, groups, least, longest), "phrases")
    named = settle(_named(phrases, words), "named")
    kept = scored(named, words, totals).join(_covered(named, longest), ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
