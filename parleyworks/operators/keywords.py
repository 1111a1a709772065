"""Keyword dictionaries of any size over texts of any number.

A dictionary is a table of (id, keyword). Its keywords become an Aho-Corasick automaton, built once in each task, which finds all of
them in one pass over a text, however many they are. A dictionary is dealt by keyword into parts of about ``part_chars``
characters, and each part is an automaton of its own that is sent to the tasks; so neither the driver nor a task holds more than a part
at a time, and texts aren't moved. What comes out are pairs (key of the text, entry), which are as many as there are hits.

As with ``contains(lower(text), keyword)``: a keyword is compared as it is with the lower-cased text, an empty keyword is in every text,
a null text or keyword meets nothing. A keyword counts once for a text. Keys of texts are distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocks


def _pairs(texts: list[str], automaton, starts: np.ndarray, ids: np.ndarray, everywhere: list[int], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the text, id, keywords found), after about ``most`` keywords' ids each time; keyword ``w`` has ``ids[starts[w]:starts[w + 1]]``."""
    scan = automaton.iter if len(automaton) else lambda _: ()
    places, words, size = [], [], 0
    for at, text in enumerate(texts):
        found = {*everywhere, *(w for _, w in scan(text))}
        places += [at] * len(found)
        words += found
        size += len(found) if len(ids) == len(starts) - 1 else sum(int(starts[w + 1] - starts[w]) for w in found)
        if size >= most or at == len(texts) - 1:
            w = np.array(words, np.int64)
            n = starts[w + 1] - starts[w]
            own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # 0, 1, ... for each keyword
            place, entry = np.repeat(np.array(places, np.int64), n), ids[np.repeat(starts[w], n) + own]
            order = np.lexsort((entry, place))
            place, entry = place[order], entry[order]
            first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (entry[1:] != entry[:-1])][: len(place)])
            yield place[first], entry[first], np.diff(np.r_[first, len(place)])
            places, words, size = [], [], 0


def _matches(df: DataFrame, keys: Sequence[str], text: str, words: pa.Table) -> DataFrame:
    """(keys, entry, found) of one part of a dictionary: ``words`` has the ids of each keyword. It travels as columns, and texts are met in blocks."""
    listed = pa.concat_arrays(words["ids"].chunks) if words.num_rows else pa.array([], pa.list_(pa.int64()))
    starts = np.r_[0, np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    known = df.sparkSession.sparkContext.broadcast((words["keyword"].combine_chunks(), starts, listed.flatten().to_numpy()))
    names = [*keys, "entry", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        given, starts, ids = known.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        everywhere = []
        for lo, some in blocks(given):
            for i, word in enumerate(some, lo):
                if word:
                    automaton.add_word(word, i)
                else:
                    everywhere.append(i)
        automaton.make_automaton()
        for batch in batches:
            for lo, texts in blocks(batch.column(len(keys))):
                for place, entry, found in _pairs(texts, automaton, starts, ids, everywhere):
                    at = pa.array(place + lo)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(entry), pa.array(found)], names)

    low = df.where(F.col(text).isNotNull()).select(*keys, F.lower(text).alias("__low"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return low.mapInArrow(run, f"{kinds}, entry long, found long")


def keyword_pairs(df: DataFrame, keys: Sequence[str], text: str, dictionary: DataFrame, part_chars: int = 8 << 20) -> DataFrame:
    """(keys, entry, found): how many keywords of each entry of ``dictionary`` (id, keyword) are in the lower-cased text of a row of ``df``, where any is."""
    words = dictionary.where("keyword is not null").groupBy("keyword").agg(F.collect_set(F.col("id").cast("long")).alias("ids"))
    chars = words.agg(F.sum(F.length("keyword") + 16 * F.size("ids"))).first()[0] or 0
    parts = max(1, math.ceil(chars / part_chars))
    dealt = words.withColumn("part", F.pmod(F.xxhash64("keyword"), F.lit(parts)))
    found = reduce(DataFrame.unionByName, (_matches(df, keys, text, dealt.where(F.col("part") == p).select("keyword", "ids").toArrow()) for p in range(parts)))
    return found if parts == 1 else found.groupBy(*keys, "entry").agg(F.sum("found").alias("found"))


def classify(df: DataFrame, keys: Sequence[str], text: str, dictionary: DataFrame, part_chars: int = 8 << 20) -> DataFrame:
    """(keys, label, ord, tier, hits, score) of the labels of ``dictionary`` (label, ord, tier, keyword) with a hit, as ``classify.keyword_hits`` scores them.

    ``ord`` is a label's own number; a keyword that a label names twice counts once.
    """
    labels = dictionary.groupBy("ord").agg(F.first("label").alias("label"), F.first("tier").alias("tier"))
    hits = keyword_pairs(df, keys, text, dictionary.select(F.col("ord").alias("id"), "keyword"), part_chars)
    score = F.least(F.lit(1.0), 0.5 + 0.25 * (F.col("found") - 1)).alias("score")
    return hits.join(labels, hits["entry"] == labels["ord"]).select(*keys, "label", "ord", "tier", F.col("found").alias("hits"), score)


def best_labels(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, score) of the best hit in the first tier that has one; ties go to the smallest ``ord``."""
    first = F.min(F.struct("tier", (-F.col("score")).alias("neg"), "ord", "label")).alias("x")
    return hits.groupBy(*keys).agg(first).select(*keys, "x.label", (-F.col("x.neg")).alias("score"))
