"""License scan: phrases at base, and an exact set-similarity join of text blocks with templates.

Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased. A block is a line,
or any run of words (below).
A template is found in a block where the block holds at least ``threshold`` of the template's
distinct words (containment). The join is exact:

* all corpus blocks give the global frequency of every template word; each template's words stand
  in that order, rarest first;
* prefix filter: with n words of which k must match, some match is among the first n - k + 1;
* length filter: a block with fewer than k words is out;
* positional filter: a first match at place i leaves n - i words, so i > n - k is out;
* what passes is verified by counting.

With ``runs`` a block is also every run of words, over line ends, that is as long as the template
(its words counted with repeats). The same filters over whole texts leave few candidates, whose
runs are then counted one by one. Templates of ``short`` are found in such runs only.

The templates are few and given (a parameter), so they go to every task; the blocks are never
moved. ``labels`` adds the labels of the templates found to those of the phrases.

Defined results: null text counts as empty; no word, no match and label strings are empty; rows
that repeat are scanned each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textvec import ALNUM, hash_word, text_bytes, text_slices, word_hashes

# The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening sentences of public licenses.
TEMPLATES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-notice": "This work is licensed under a Creative Commons Attribution International License",
    "unlicense-notice": "This is free and unencumbered software released into the public domain",
    "warranty-notice": "The software is provided as is, without warranty of any kind, express or implied",
    "rights-notice": "All rights reserved. No part of this publication may be reproduced without permission",
}

#: Whole texts of short licenses and the notices of long ones, a file each, by label.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}

# Notices too short for a share of their words to tell them apart; all words stand together.
SHORT = {"cc-by-nc": "CC BY-NC", "rights-reserved": "All rights reserved"}


def _words(text: str) -> list[str]:
    low = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).lower()
    return low.split()


class _Vocabulary:
    """Hashes of the words of phrases and templates, and each template as a row of marks."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.labels = list(templates)
        self.sets = [set(_words(t)) for t in templates.values()]
        self.phrases = [(_words(p), label) for p, label in phrases.items()]
        words = sorted({w for s in self.sets for w in s} | {w for p, _ in self.phrases for w in p})
        hashes = np.array([hash_word(w, ALNUM) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.words, self.hashes = [words[i] for i in order], hashes[order]
        self.id = {w: i for i, w in enumerate(self.words)}

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words of no phrase or template."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _blocks(voc: _Vocabulary, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: rows, word ids, words by row, and block number of each word."""
    for lo, hi in text_slices(text):
        raw, offsets = text_bytes(text.slice(lo, hi - lo))
        h, first, counts = word_hashes(raw, offsets, ALNUM)
        newline = np.zeros(len(raw) + 1, bool)
        newline[:-1] = raw == 10
        newline[offsets[:-1]] = True
        block = np.searchsorted(np.flatnonzero(newline), first, "right")
        yield lo, hi, voc.ids(h), counts, block


def word_frequencies(docs: DataFrame, voc: _Vocabulary) -> np.ndarray:
    """In how many blocks of the whole corpus each vocabulary word stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(voc.words), np.int64)
        for batch in batches:
            for _, _, ids, _, block in _blocks(voc, batch.column(0)):
                known = ids >= 0
                pairs = np.unique(block[known] * len(voc.words) + ids[known])
                total += np.bincount(pairs % len(voc.words), minlength=len(voc.words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word int, n long")
    out = np.zeros(len(voc.words), np.int64)
    for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row for each word of the templates
        out[r["word"]] = r["n"]
    return out


class _Join:
    """The templates in frequency order with their filters."""

    def __init__(self, voc: _Vocabulary, frequency: np.ndarray, threshold: float):
        self.member = np.zeros((len(voc.words), len(voc.sets)), bool)
        self.place = np.zeros((len(voc.words), len(voc.sets)), np.int64)
        self.size = np.array([len(s) for s in voc.sets])
        self.need = np.array([max(1, math.ceil(threshold * n - 1e-9)) for n in self.size])
        for t, words in enumerate(voc.sets):
            ranked = sorted((voc.id[w] for w in words), key=lambda i: (frequency[i], voc.words[i]))
            self.member[ranked, t] = True
            self.place[ranked, t] = np.arange(len(ranked))
        self.prefix = self.member & (self.place <= self.size - self.need)

    def matches(self, block: np.ndarray, word: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks and templates that match, with the containment. (block, word): distinct, sorted."""
        i, t = np.nonzero(self.prefix[word])
        pairs = np.unique(block[i] * len(self.size) + t)
        b, t = pairs // len(self.size), pairs % len(self.size)
        ok = length[b] >= self.need[t]
        b, t = b[ok], t[ok]
        lo, hi = np.searchsorted(block, b), np.searchsorted(block, b, "right")
        found, score = np.zeros(len(b), bool), np.zeros(len(b))
        for j in range(len(b)):
            own = word[lo[j] : hi[j]]
            own = own[self.member[own, t[j]]]
            first = self.place[own, t[j]].min()
            if self.size[t[j]] - first < self.need[t[j]]:
                continue
            found[j] = len(own) >= self.need[t[j]]
            score[j] = len(own) / self.size[t[j]]
        return b[found], t[found], score[found]


def _best_run(has: np.ndarray, word: np.ndarray, length: int) -> tuple[int, int]:
    """The most distinct words of a template in ``length`` words on, and where that run begins."""
    at, own = np.flatnonzero(has), word[has]
    inside: dict[int, int] = {}
    best, begin, lo = 0, 0, 0
    for hi in range(len(at)):
        inside[own[hi]] = inside.get(own[hi], 0) + 1
        while at[hi] - at[lo] >= length:
            inside[own[lo]] -= 1
            if not inside[own[lo]]:
                del inside[own[lo]]
            lo += 1
        if len(inside) > best:
            best, begin = len(inside), int(at[lo])
    return best, begin


def license_scan(
    docs: DataFrame, threshold: float = 0.8, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, runs: bool = False, short: Mapping[str, str] = {}
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (block, template, containment)."""
    bounded_batches(docs)
    every = {**templates, **short}
    voc = _Vocabulary(phrases, every)
    lengths = [len(_words(t)) for t in every.values()]
    by_line = len(templates)
    join = _Join(voc, word_frequencies(docs, voc), threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = voc.labels
    spots = pa.list_(pa.struct([("line", pa.int64()), ("template", pa.string()), ("containment", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cols: list[list] = [[] for _ in range(8)]
            for lo, hi, ids, counts, block in _blocks(voc, batch.column(1)):
                ends = np.cumsum(counts)
                begins = ends - counts
                row_of_word = np.repeat(np.arange(hi - lo), counts)
                base: list[set] = [set() for _ in range(hi - lo)]
                places = []
                for words, label in voc.phrases:
                    hit = np.flatnonzero(ids[: len(ids) - len(words) + 1] == voc.id[words[0]]) if len(ids) >= len(words) else np.zeros(0, np.int64)
                    for k, w in enumerate(words[1:], 1):
                        hit = hit[(ids[hit + k] == voc.id[w]) & (row_of_word[hit + k] == row_of_word[hit])]
                    places.append(hit)
                    for r in np.unique(row_of_word[hit]):
                        base[r].add(label)
                at = np.sort(np.concatenate(places))
                rows = row_of_word[at]
                n_base = np.bincount(rows, minlength=hi - lo)
                first = np.full(hi - lo, -1)
                last = np.full(hi - lo, -1)
                inside = at - begins[rows]
                first[rows[::-1]] = inside[::-1]
                last[rows] = inside
                known = ids >= 0
                pairs = np.unique(block[known].astype(np.int64) * len(voc.words) + ids[known])
                n_blocks = int(block[-1]) + 1 if len(block) else 1
                b, t, c = join.matches(pairs // len(voc.words), pairs % len(voc.words), np.bincount(block, minlength=n_blocks))
                by_lines = t < by_line
                b, t, c = b[by_lines], t[by_lines], c[by_lines]
                extra = [set(x) for x in base]
                spot: list[list] = [[] for _ in range(hi - lo)]
                score = (n_base > 0).astype(float)
                if len(b):
                    first_word = np.searchsorted(block, b)
                    r = row_of_word[first_word]
                    top = block[begins[r]]
                    for i, (row, line, tpl, con) in enumerate(zip(r, b - top, t, c, strict=True)):
                        extra[row].add(names[tpl])
                        spot[row].append({"line": int(line), "template": names[tpl], "containment": float(con)})
                        score[row] = max(score[row], con)
                if runs or short:
                    pairs = np.unique(row_of_word[known].astype(np.int64) * len(voc.words) + ids[known])
                    at_rows, tpls, _ = join.matches(pairs // len(voc.words), pairs % len(voc.words), counts)
                    for row, tpl in zip(at_rows.tolist(), tpls.tolist(), strict=True):
                        if tpl < by_line and not runs:
                            continue
                        own = ids[begins[row] : ends[row]]
                        most, begin = _best_run((own >= 0) & join.member[own, tpl], own, lengths[tpl])
                        if most < join.need[tpl]:
                            continue
                        con = most / join.size[tpl]
                        score[row] = max(score[row], con)
                        if not any(x["template"] == names[tpl] for x in spot[row]):
                            line = block[begins[row] + begin] - block[begins[row]]
                            spot[row].append({"line": int(line), "template": names[tpl], "containment": float(con)})
                        extra[row].add(names[tpl])
                cols[0] += counts.tolist()
                cols[1] += n_base.tolist()
                cols[2] += [x if x >= 0 else None for x in first.tolist()]
                cols[3] += [x if x >= 0 else None for x in last.tolist()]
                cols[4] += [",".join(sorted(x)) for x in base]
                cols[5] += [",".join(sorted(x)) for x in extra]
                cols[6] += score.tolist()
                cols[7] += spot
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spots]
            assert all(len(x) == n for x in cols)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(cols, types, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<line:bigint,template:string,containment:double>>",
    )
