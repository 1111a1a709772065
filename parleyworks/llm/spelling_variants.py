r"""Spelling variants of a corpus' words by PartEnum signatures.

A word's letters with multiplicity are a binary vector: one dimension for each letter and each of its
occurrences. One inserted or deleted letter changes one dimension, a replaced one two, so words that
differ by one code point have Hamming distance at most two. The dimensions are dealt to ``first`` parts,
of which one differs in at most ``2 // first`` dimensions; that part's dimensions are dealt to ``second``
groups, and each choice of all groups but that many is a signature: two words within the distance share
one, so the equi-join on signatures misses none. Every pair that meets is verified inside the join, by its
edit distance.

Letters go to groups by their count over all words, the heaviest to the lightest group, so signatures
are about equally selective. There are at most 90 letters, so that table is bounded.

Words are counted in the tasks that read the texts, with the count of each distinct word leaving a task
once in ``flush`` distinct words, and then added up by Spark. A text is read in slices that end between
words, so a long text is no long list of words. The spelling noise of the contract (a letter deleted where
199 divides the crc32 of ``<doc_id>:<run>``) is a function of id and run, so slices decide alike.

Defined results: a null text or one without letters has no words; a null doc_id counts as the text
``null``; rows that repeat count again; ties for the form go to the smallest word; an empty table gives
an empty result; further columns, whatever their names, are not read. A run of any length is one word.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, settle
from .textvec import mix

#: Letters are A-Z, a-z and U+00C0 to U+00FF; as UTF-8 the latter are the byte C3 and another one.
_OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_NOT_LETTER = re.compile(rb"[^A-Za-z\x80-\xff]")
_DISTANCE = 2


def runs(raw: bytes) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased."""
    return (_OTHER.sub(b" ", raw) if _OTHER.search(raw) else raw).translate(_FOLD).split()


def slices(raw: bytes, size: int) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes, each but the last ending at an ASCII byte that is no letter."""
    lo = 0
    while len(raw) - lo > size:
        cut = _NOT_LETTER.search(raw, lo + size)
        if cut is None:
            break
        yield raw[lo : cut.end()]
        lo = cut.end()
    yield raw[lo:] if lo else raw


def noisy(run: bytes, h: int) -> bytes:
    """``run`` without its code point number ``h`` modulo its length."""
    text = run.decode()
    i = h % len(text)
    return (text[:i] + text[i + 1 :]).encode()


def count_words(docs: DataFrame, modulus: int = 199, size: int = 1 << 16, flush: int = 500_000) -> DataFrame:
    """(word, n) of the noisy lower-cased runs of all texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "text").where("text is not null")
    bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made.filter(pc.field("n") > 0)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for piece in slices(text.as_buffer().to_pybytes(), size):
                    found = runs(piece)
                    total.update(found)
                    for w in set(found):
                        if (h := zlib.crc32(w, start)) % modulus == 0:
                            n = found.count(w)
                            total[w] -= n
                            total[noisy(w, h)] += n
                    if len(total) > flush:
                        yield out()
        if total:
            yield out()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int) -> dict[str, int]:
    """A group for each letter: heaviest letters first, each to the group with the least weight so far."""
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()
    weight = [0] * groups
    found = {}
    for r in counts:
        i = weight.index(min(weight))
        found[r["letter"]] = i
        weight[i] += r["count"]
    return found


def signed(words: DataFrame, first: int = 1, second: int = 8) -> DataFrame:
    """(word, n, signature, skip_0, skip_1, alone_0, alone_1): a row for each part and choice of its groups.

    A group's letters are summed up as random numbers, so equal multisets have equal sums. The sums of the groups that a choice
    leaves out stand beside it.
    """
    spare = _DISTANCE // first
    if second <= spare:
        raise ValueError("a part needs more groups than the distance that it tolerates")
    of = np.full(256, -1, np.int8)
    for letter, g in letter_groups(words, first * second).items():
        of[ord(letter)] = g
    chosen = [(p * second, skip) for p in range(first) for skip in itertools.combinations(range(second), spare)]
    seen: set[int] = set()
    alone = [[g not in seen and not seen.add(g) for g in skip] for _, skip in chosen]
    names = ["word", "n", "signature", *(f"skip_{i}" for i in range(spare)), *(f"alone_{i}" for i in range(spare))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(0).to_pylist()
            codes = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
            starts = np.cumsum([0, *map(len, texts[:-1])])
            value = mix(codes.astype(np.uint64) + np.uint64(1))
            sums = np.stack([np.add.reduceat(np.where(of[codes] == g, value, np.uint64(0)), starts) for g in range(first * second)])
            for no, (base, skip) in enumerate(chosen):
                own = np.full(len(texts), no, np.uint64)
                for g in range(second):
                    if g not in skip:
                        own = mix(own * np.uint64(0x9E3779B97F4A7C15) + sums[base + g])
                left = [pa.array(sums[base + g].view(np.int64)) for g in skip]
                flags = [pa.array(np.full(len(texts), x)) for x in alone[no]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.view(np.int64)), *left, *flags], names)

    kinds = ["string", "long", "long", *["long"] * spare, *["boolean"] * spare]
    return words.select("word", "n").mapInArrow(run, ", ".join(f"{x} {k}" for x, k in zip(names, kinds, strict=True)))


def _first_meeting() -> Column:
    """Whether no choice before this one gives a and b the same signature.

    Choices leave out two groups, in lexicographic order. The groups that differ must be left out; where one differs, the first such
    choice is marked ``alone``. Words without a difference are anagrams, which are never one edit apart.
    """
    one, two = (F.col(f"a.skip_{i}") != F.col(f"b.skip_{i}") for i in (0, 1))
    return (one & (two | F.col("a.alone_0"))) | (two & F.col("a.alone_1"))


def near_pairs(words: DataFrame, first: int = 1, second: int = 8) -> DataFrame:
    """(word, n, other, other_n): each word with each of its near words, both ways. ``words`` (word, n) is settled.

    The signatures are many times the words, so they are written for Spark to plan with their size and joined by sorting, where
    it splits a hot signature. With one part a pair is verified where it first meets; with several, where the differences may lie in another part,
    pairs are made one afterwards.
    """
    rows = settle(signed(words, first, second), "signatures").hint("merge")
    a, b = rows.alias("a"), rows.alias("b")
    met = (F.col("a.signature") == F.col("b.signature")) & (F.abs(F.length("a.word") - F.length("b.word")) <= 1)
    if first == 1:
        met = met & _first_meeting()
    one_apart = (F.col("a.word") < F.col("b.word")) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    pairs = a.join(b, met & one_apart).select(*(F.col(x).alias(y) for x, y in (("a.word", "word"), ("a.n", "n"), ("b.word", "other"), ("b.n", "other_n"))))
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return (pairs.distinct() if first > 1 else pairs).select(F.explode(both).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms. ``forms`` has (word, form) of the words with a form.

    Each round doubles the part of a chain that is behind it; a chain has at most log5 of the largest count
    links, as each is five times as frequent as the one before.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = settle(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, first: int = 1, second: int = 8) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``least_length`` code points and ``least_count`` occurrences."""
    words = settle(count_words(docs).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), "other"))  # largest count, then smallest word
    near = near_pairs(words, first, second).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = settle(near.withColumn("form_n", F.when(-F.col("best.rank") >= ratio * F.col("n"), -F.col("best.rank"))).select("word", "n_near", "form_n", F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form")), "near")
    ends = roots(found.where("form is not null"))
    joined = words.join(found, "word", "left").join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
