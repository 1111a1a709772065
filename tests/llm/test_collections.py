"""Spelling variants, collocations and repeated passages against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parleyworks.llm import column_bwt, phrase_mining, spelling_variants, suffix_dedup

from .test_operators import odd

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---- 11 spelling variants


def variants(rows, least_length, least_count):
    n = Counter()
    for i, text in rows:
        for w in RUN.findall(lower(text or "")):
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), k, count[w], n.get(form[w])) for w, k in n.items()), key=repr)


@pytest.mark.parametrize("parts", [(1, 8), (1, 4), (2, 3), (3, 2)])
def test_spelling_variants(spark, parts):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randrange(3, 8))) for _ in range(12)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(60)):
            w = base[min(int(rng.expovariate(0.4)), 11)]
            for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("xaé") + w[at + 1 :])) or "a"
            words.append(rng.choice((w, w.upper())))
        rows.append((i if i % 9 else None, rng.choice((" ", "-", "退", "×1", "\n")).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling_variants.spelling_variants(df, least_length=3, least_count=2, first=parts[0], second=parts[1])
    want = variants(rows, 3, 2)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == want
    assert any(w[1] and w[2] != w[1] for w in want)  # chains of two


def test_spelling_variants_odd(spark):
    assert spelling_variants.spelling_variants(odd(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "Lettern " * 5), (3, "Lettern " * 5), (None, "letter" * 50_000), (4, "lettern, " * 100_000)]
    got = {r.word: r.n for r in spelling_variants.spelling_variants(odd(spark, rows)).collect()}
    assert got == {w: n for w, _, _, n, _, _ in variants(rows, 6, 5)} and len(got) >= 1


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB é退À\n-", max_size=60), st.integers(1, 9))
def test_runs_in_slices(text, size):
    raw = text.encode()
    assert [w.decode() for piece in spelling_variants.slices(raw, size) for w in spelling_variants.runs(piece)] == [lower(w) for w in RUN.findall(text)]


# ---- 12 phrase mining


def phrases(rows, least, longest, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(k for p, k in c.items() if len(p) == 1)
        found = {p: k for p, k in c.items() if len(p) > 1 and k >= least}
        covered = {p[i : i + k] for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * found[p] >= 100 * found[p[i : i + k]]}
        rows = []
        for p, a in found.items():
            score, _, le, r = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if p not in covered:
                rows.append((-score, -a, " ".join(p).encode(), le, r, n))
        rows.sort()
        out += [(lang, i, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r, n) in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"budget": 30}, {"budget": 30, "filter_bits": 1 << 10}, {"longest": 3, "budget": 20}, {"top": 3}])
def test_phrases(spark, how):
    rng = random.Random(8)
    words = ["the", "of", "É", "é", "x", "退", "a b"] + [f"w{i}" for i in range(30)]
    rows = [(rng.choice(("en", "de", None, "und")), "".join(words[min(int(rng.expovariate(0.25)), 36)] + rng.choice((" ", " ", " ", "\t", "  ", ". ", "\n", ",")) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", "The quick  brown fox jumps over the. lazy"), (None, None), ("en", "")] * 5
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = phrase_mining.phrase_mining(df, least=4, **how)
    want = phrases(rows, 4, how.get("longest", 5), how.get("top", 2000))
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want and len(want) > 8


def test_phrases_odd(spark):
    assert phrase_mining.phrase_mining(odd(spark, [])).count() == 0
    rows = [(1, None), (2, "a"), (3, "a b " * 200_000), (3, "Lang " * 300), (None, "退" * 100_000)]
    got = phrase_mining.phrase_mining(odd(spark, rows), least=100)
    named = [("und" if (i or 0) % 2 else "en", t) for i, t in rows]
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases(named, 100, 5, 2000)


# ---- 13 suffix-array dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.sampled_from([2, 5, 50]))
def test_columns_of_a_collection(strings, cap):
    """The transform and common prefixes are those of the sorted suffixes, ends by number of the string."""
    order = sorted((([(1, c) for c in s[i:]] + [(0, no)], no, len(s) - i) for no, s in enumerate(strings) for i in range(len(s) + 1)))
    text = {(no, n): strings[no][len(strings[no]) - n :] for _, no, n in order}
    common = [0]
    for (_, a, m), (_, b, n) in zip(order, order[1:], strict=False):
        x, y = text[a, m], text[b, n]
        common.append(min(cap, next((i for i in range(min(m, n)) if x[i] != y[i]), min(m, n))))
    lengths = np.array([len(s) for s in strings])
    transform, prefixes = column_bwt.build(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths, cap)
    assert transform.tolist() == [strings[no][-n - 1] if n < len(strings[no]) else column_bwt.END for _, no, n in order]
    assert prefixes.tolist() == common
    found = zip(*(x.tolist() for x in column_bwt.suffix_places(transform, lengths, 2)), strict=True)
    assert sorted(found) == [(i, no, n) for i, (_, no, n) in enumerate(order) if n >= 2]


def passages(rows, width=50):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - width + 1):
            first[raw[p : p + width]] = min(first.get(raw[p : p + width], key(i)), key(i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] < key(i):
                gone[p : p + width] = b"\1" * width
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def removed(df, **how):
    rows = suffix_dedup.suffix_dedup(df, **how).collect()
    assert all(sum(s["end"] - s["start"] for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)


@pytest.mark.parametrize("how", [{}, {"hot": 3}, {"hot": 2, "bucket": 20, "block": 500, "anchors": 50}, {"gram": 8}, {"gram": 48}])
def test_suffix_dedup(spark, how):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é退") for _ in range(300)) for _ in range(6)] + ["=" * 400, "ab" * 300]
    rows = []
    for i in range(120):
        text = "".join((lambda b, a: b[a : a + rng.randrange(20, 120)])(rng.choice(base), rng.randrange(200)) for _ in range(rng.randrange(6)))
        rows.append((rng.choice((i, i, i, None, 5)), rng.choice((text, None)) if i % 7 == 0 else text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(df, **how) == passages(rows)


def test_suffix_dedup_odd(spark):
    assert suffix_dedup.suffix_dedup(odd(spark, [])).count() == 0
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, long[:90_000]), (None, None), (4, long), (4, long[5:500]), (7, "x" * 49), (6, "x" * 50), (8, "x" * 3000)]
    assert removed(odd(spark, rows)) == passages(rows)


def sent(texts, width=50, gram=24, buckets=6, hot=3, **how):
    """Rows of pieces from blocks of a text each, every anchor of which counts as repeated (in five documents where hashes are even)."""
    made = []
    for i, text in enumerate(texts):
        found = np.unique(np.concatenate([x for _, _, x in suffix_dedup.pieces(np.frombuffer(text, np.uint8), np.array([len(text)]), width, gram)]))
        totals = np.where(found % 2 == 0, 5, 2).astype("<u8")
        made.append({"block": i, "ids": [i], "sizes": [len(text)], "texts": suffix_dedup._zip(text), "found": [suffix_dedup._zip(found)], "totals": [suffix_dedup._zip(totals)]})
    batches = (pa.RecordBatch.from_pylist(made[k : k + 7]) for k in range(0, len(made), 7))
    return [r for batch in suffix_dedup._sent_pieces(width, gram, buckets, hot, **how)(batches) for r in batch.to_pylist()]


def test_rows_of_pieces_do_not_grow_with_blocks_times_buckets():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(400)) for _ in range(60)]
    rows = sent(texts)
    assert len(rows) <= 2 * 6  # a row for each bucket, of hot and of other anchors


def test_pieces_of_many_blocks_are_those_of_each():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.choice((60, 400)))) for _ in range(40)]
    want = sorted((i, int(a), int(k), text[a : a + k + 49]) for i, text in enumerate(texts) for first, count, _ in suffix_dedup.pieces(np.frombuffer(text, np.uint8), np.array([len(text)]), 50, 24) for a, k in zip(first, count, strict=True))
    for how in ({}, {"most": 50}, {"text": 1000}, {"most": 1, "text": 1}):
        got = []
        for r in sent(texts, **how):
            (h, doc, block, first, owner, count), text = suffix_dedup._unpack(r["pieces"], r["n"])
            assert (np.diff(h.astype(object)) >= 0).all() and set(owner.tolist()) == {0} and doc.tolist() == block.tolist()
            assert set(suffix_dedup._bucket(h, 6).tolist()) == {r["bucket"]}
            ends = np.cumsum(count.astype(int) + 49)
            got += [(d, f, k, text[z - k - 49 : z]) for d, f, k, z in zip(doc.tolist(), first.tolist(), count.tolist(), ends.tolist(), strict=True)]
        assert sorted(got) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=9, max_size=25).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=6, unique=True))
def test_stretches_that_two_strings_share(strings):
    """No window of two strings lies outside of their stretches, and without collisions nothing else is in."""
    width = 9
    where = {}
    for i, s in enumerate(strings):
        for p in range(len(s) - width + 1):
            where.setdefault(s[p : p + width], set()).add(i)
    shared = [[p for p in range(len(s) - width + 1) if len(where[s[p : p + width]]) > 1] for s in strings]
    lengths = np.array([len(s) for s in strings])
    found = suffix_dedup._shared_stretches(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths - width + 1, width)
    assert list(zip(*(x.tolist() for x in found), strict=True)) == [(i, p[0], p[-1]) for i, p in enumerate(shared) if p]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), min_size=1, max_size=40))
def test_texts_of_each_anchor(pairs):
    anchors, owners = (np.array(x) for x in zip(*pairs, strict=True))
    got = suffix_dedup._owned(anchors.astype(np.uint64), owners)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(a, len({o for b, o in pairs if b == a})) for a in sorted({a for a, _ in pairs})]
