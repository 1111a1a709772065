"""The training-data operators against brute force, round trips and held-out rows, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parleyworks.llm import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, packing, quality_rules, quotient_filter, textvec, token_counts, toxicity
from parleyworks.llm.common import bounded_sample, table
from parleyworks.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import differences

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, `__ld_host` string, labels string"


def odd(spark, rows=None):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = rows if rows is not None else [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "A b c"), (None, None), (4, long), (5, "x\n\n\ny\n"), (6, "ÄÖ é　z"), (7, "  \n "), (8, "!!! 123")]
    return spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", None if (i or 0) % 3 else "s", None, "c", "h", "l") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, small, name):
    assert differences(QUERIES[name](spark, small), ORACLE_SQL[name], small) == []


# ---- helpers


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB \né退9", max_size=12), max_size=6))
def test_word_hashes(texts):
    col = pa.array(texts, pa.large_string())
    h, first, counts = textvec.word_hashes(*textvec.text_bytes(col), textvec.LETTERS)
    want = [re.findall(rb"[A-Za-z\x80-\xff]+", t.encode()) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert h.tolist() == [textvec.hash_word(w.decode(), textvec.LETTERS) for ws in want for w in ws]
    assert len(first) == len(h)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 200), max_size=40), min_size=1, max_size=5), st.sampled_from([8, 20, 53]))
def test_quotient_filters_merge_without_loss(parts, bits):
    packed = []
    for p in parts:
        f = np.array([(x * 0x9E3779B97F4A7C15) % (1 << bits) for x in p], np.uint64)
        f, c = quotient_filter.add_up(f, np.ones(len(f), np.uint64))
        packed.append(quotient_filter.pack(f, c, bits))
        assert [x.tolist() for x in quotient_filter.unpack(packed[-1])] == [f.tolist(), c.tolist()]
    f, c = quotient_filter.merge(packed)
    want = Counter((x * 0x9E3779B97F4A7C15) % (1 << bits) for p in parts for x in p)
    assert dict(zip(f.tolist(), c.tolist(), strict=True)) == want and f.tolist() == sorted(want)


# ---- 1 mixing


def test_mixing_rates(spark):
    df = spark.createDataFrame([(i, "x" * 10, "a" if i % 4 else "b") for i in range(8000)], "doc_id long, text string, source string")
    got = {r.source: r.n for r in mixing.mix(df, {"a": 1, "b": 3}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 6000) < 300
    share = Counter(r.copies for r in mixing.mix(df.where("source = 'b'"), {"b": 1}).where("copy_no = 1").collect())
    assert abs(share[1] / 2000 - 0.368) < 0.04 and abs(share[2] / 2000 - 0.184) < 0.03
    keys = [r.shuffle_key for r in mixing.mix(df).collect()]
    assert len(set(keys)) == len(keys)


def test_mixing_repeats_a_short_source_often(spark):
    df = spark.createDataFrame([(i, "x" * (1000 if i else 1), "b" if i else "a") for i in range(2000)], "doc_id long, text string, source string")
    for terms in (2_000_000, 0):
        got = {r.source: r.n for r in mixing.mix(df, {"a": 1, "b": 3}, epochs=0.1, broadcast_terms=terms).groupBy("source").agg(F.count("*").alias("n")).collect()}
        assert abs(got["a"] - 49_975) < 1500 and abs(got["b"] - 150) < 60


def test_mixing_odd(spark):
    assert mixing.mix(odd(spark, [])).count() == 0
    got = mixing.mix(odd(spark), epochs=50).collect()
    assert {r.doc_id for r in got if r.text} and all(r.copies > 0 for r in got)
    assert mixing.mix(odd(spark), {"none": 1.0}).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.01, 1.0, 7.5, 150.0, 1500.0, 1e6])
def test_poisson_cdf(spark, mean):
    r = mixing.poisson_cdf(spark.createDataFrame([("a", mean)], "source string, rate double")).first()
    assert len(r.cdf) <= 24 * mean**0.5 + 70 and r.cdf[-1] == 1 and list(r.cdf) == sorted(r.cdf)
    log_p = lambda k: -mean + (k * math.log(mean) if k else 0) - math.lgamma(k + 1)
    total = 0.0
    for i, c in enumerate(r.cdf[:30_000]):
        total += math.exp(log_p(r.least + i)) if mean else 1.0
        assert abs(c - total) < 1e-7


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40).map(sorted), st.integers(-1, 10))
def test_places_up_to(spark, ordered, x):
    got = spark.range(1).select(mixing.places_up_to(F.array(*map(F.lit, ordered)), F.lit(x)).alias("n")).first().n
    assert got == sum(v <= x for v in ordered)


# ---- 2 toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    r = QUERIES["op2_toxicity_nnpu"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    tp, fp, fn = r.selectExpr("count_if(toxic=1 and predicted=1)", "count_if(toxic=0 and predicted=1)", "count_if(toxic=1 and predicted=0)").first()
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.75


def test_nnpu_separates():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    x = np.c_[truth & (rng.random(4000) < 0.9), rng.random(4000) < 0.3].astype(float)
    positive = truth & (rng.random(4000) < 0.3)
    w, b = toxicity.fit_nnpu(x, positive, 0.15, np.zeros(2))
    assert w[0] + b > 0 > b and abs(w[1]) < w[0] / 2


def test_nnpu_step_is_the_gradient_of_the_risk():
    """The first step of Adam has the sign of the gradient; finite differences of the corrected risk give it."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (60, 4)).astype(float)
    positive, prior, decay = rng.random(60) < 0.4, 0.3, 1e-4
    sigma = lambda z: 1 / (1 + np.exp(-z))

    def risk(w, b, flip):
        p, u = sigma(x[positive] @ w + b), sigma(x[~positive] @ w + b)
        rest = u.mean() - prior * p.mean()
        return (-rest if flip else prior * (1 - p).mean() + rest) + decay * prior * (w @ w) / 2

    for start in (np.array([0.5, -0.3, 0.2, 0.1]), np.array([6.0, 6.0, 6.0, 6.0]), rng.normal(0, 3, 4)):
        b0 = float(np.log(prior / (1 - prior)))
        p, u = sigma(x[positive] @ start + b0), sigma(x[~positive] @ start + b0)
        flip = u.mean() - prior * p.mean() < 0
        w, b = toxicity.fit_nnpu(x, positive, prior, start, steps=1, rate=1e-3, decay=decay)
        e = 1e-6
        grad = [(risk(start + e * d, b0, flip) - risk(start - e * d, b0, flip)) / (2 * e) for d in np.eye(4)]
        grad.append((risk(start, b0 + e, flip) - risk(start, b0 - e, flip)) / (2 * e))
        moved = np.r_[w - start, b - b0]
        assert all(np.sign(m) == -np.sign(g) for m, g in zip(moved, grad) if abs(g) > 1e-6)


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 1), (3, None), (4, 1), (5, 0), (99, 1), (None, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd(spark), labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.score == 0 for r in toxicity.toxicity(odd(spark), labels.limit(0)).collect())
    assert toxicity.toxicity(odd(spark, []), labels).count() == 0


# ---- 3 languages


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    r = QUERIES["op3_language_mixture"](spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out")
    assert r.selectExpr("avg(int(lang = lang_pred))").first()[0] > 0.98


def test_language_mixture_shares(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars between 1500 and 2500").dropDuplicates(["lang"]).collect()}
    df = spark.createDataFrame([(1, texts["en"] + "\n" + texts["de"])], "doc_id long, text string")
    langs = {x["lang"]: x["share"] for x in language_id.detect_language(df, model).first().langs}
    assert set(langs) == {"en", "de"} and min(langs.values()) > 0.3


def plain_mixture(lls, penalty=2.0, steps=6):
    """Expectation-maximisation and the choice of the set, word by word."""
    langs = range(len(lls[0]))
    likes = [[math.exp(max(x - max(ll), -12)) for x in ll] for ll in lls]

    def em(share, steps):
        for _ in range(steps):
            share = [sum(w[i] * share[i] / sum(a * b for a, b in zip(w, share)) for w in likes) / len(likes) for i in langs]
        return share, sum(math.log(sum(a * b for a, b in zip(w, share)) + 1e-30) for w in likes)

    whole, _ = em([1 / len(langs)] * len(langs), steps)
    order = sorted(langs, key=lambda i: -whole[i])
    fits = []
    for k in range(1, len(langs) + 1):
        share, fit = em([1 / k if i in order[:k] else 0 for i in langs], 0 if k == 1 else steps)
        fits.append((fit - penalty * math.log(len(likes) + 1) * (k - 1), share))
    return max(fits, key=lambda x: x[0])[1]


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_mixture_against_a_plain_loop(monkeypatch, size):
    rng = random.Random(8)
    model = np.random.default_rng(8).normal(-10, 1.5, (1 << 16, 5)).astype(np.float32)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 150))) for _ in range(30)]
    monkeypatch.setattr(language_id, "_SLICE", size)
    slots = lambda word: language_id._trigrams(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0]
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        want = plain_mixture([model[slots(x)].sum(0).tolist() for x in t.split()])
        assert np.abs(language_id.infer(raw, np.array([0, len(raw)]), model)[0] - want).max() < 1e-3


def test_long_text_in_bounded_memory():
    import tracemalloc

    raw = np.frombuffer(b"some words of a very long text and more of them \xc3\xa9\xe9\x80\x80" * 600_000, np.uint8)
    model = np.random.default_rng(8).normal(-10, 1.5, (1 << 16, 4)).astype(np.float32)
    tracemalloc.start()
    share = language_id.infer(raw, np.array([0, len(raw)]), model)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(share.sum() - 1) < 1e-3 and top < 300e6 and len(raw) > 30e6


def test_languages_odd(spark):
    got = language_id.language_id(odd(spark)).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == 11 and (1, "und") in by and (8, "und") in by and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.language_id(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_id(odd(spark, [])).count() == 0


# ---- 4 rules


def test_rule_order_changes_no_verdict(spark, small):
    measured = quality_rules.measure(table(spark, small, "documents"))
    a, b = (measured.select("doc_id", quality_rules.cascade(measured, rules).alias("k")) for rules in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1]))
    assert a.exceptAll(b).count() == 0
    assert {r.name for r in quality_rules.order_rules(table(spark, small, "documents"))} == {r.name for r in quality_rules.RULES}


def test_rules_odd(spark):
    got = quality_rules.quality_rules(odd(spark)).collect()
    assert len(got) == 11 and {r.doc_id: r.n_words for r in got}[4] == 60_000
    assert all(r.base_failed and not r.kept for r in got if r.doc_id != 4)
    assert quality_rules.quality_rules(odd(spark, [])).count() == 0


# ---- 5 token counts


def test_token_counts_on_whole_table(spark, small):
    model, seams = token_counts.load(PIECES)
    assert seams.before_blank
    want = {r.doc_id: len(model.encode(r.text)) for r in table(spark, small, "documents").collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, small, "documents"), PIECES, chunk=500, overlap=16).collect()}
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n退é▁.😀"), max_size=300), st.integers(8, 60), st.integers(1, 20))
def test_spliced_counts(text, chunk, overlap):
    model, seams = token_counts.load(PIECES)
    assert token_counts.count_long(model, seams, text.encode(), chunk, overlap) == len(model.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("的一是中国人日本語カタ゛がกาำไ한ᄀ글ABz9/+e\u0301é😀\u200d"), max_size=400), st.integers(8, 60), st.sampled_from([1, 7, 40]))
def test_spliced_counts_without_blanks(text, chunk, overlap):
    model, seams = token_counts.load(PIECES)
    assert token_counts.count_long(model, seams, text.encode(), chunk, overlap) == len(model.encode(text))


@pytest.mark.parametrize("alphabet", ["的一是中国人在有我他这为之大来以个上们到说时要就出会可也你对生能而子那得于着下自", "กขคงจฉชซญดตถทธนบปผพฟมยรลวสหอาิีุู", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_long_texts_without_blanks_are_spliced(alphabet):
    """Each chunk meets the next; none doubles up to the whole text."""
    model, seams = token_counts.load(PIECES)
    text = "".join(random.Random(1).choices(alphabet, k=300_000))
    longest = 0

    class Watched:
        def encode(self, part, **how):
            nonlocal longest
            longest = max(longest, len(part.encode()))
            return model.encode(part, **how)

    assert token_counts.count_long(Watched(), seams, text.encode(), 1 << 15, 256) == len(model.encode(text))
    assert longest <= 1 << 15


def test_token_counts_odd(spark):
    got = token_counts.count_tokens(odd(spark), PIECES).collect()
    assert len(got) == 11 and {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (1, 2)} == {(0, 0)}
    assert [r.over_limit for r in got if r.doc_id == 4] == [True]
    assert token_counts.count_tokens(odd(spark, []), PIECES).count() == 0


# ---- 6 join


def brute_pairs(rows):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 5 * (n := len(sets[i] & sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - n)]


def near_rows(seed=3):
    """Groups of near copies of different sizes, copies of copies, and texts alone."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (2, 3, 30, 120):
        base = [word() for _ in range(200)]
        for _ in range(size):
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(200)] = word()
            rows += [" ".join(w)] * rng.choice((1, 1, 2))
    rows += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(80)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"limit": 16, "block": 16}, {"limit": 8, "block": 8, "broadcast_sets": 0}, {"limit": 8, "block_tokens": 1000}])
def test_join_against_brute_force(spark, options):
    rows = near_rows()
    want, label = Counter(), list(range(len(rows)))
    for i, j in brute_pairs(rows):
        want[i] += 1
        want[j] += 1
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == {i: (label[i], want[i]) for i, _ in rows}


def test_join_on_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    want = Counter(rows[k][0] for p in brute_pairs(rows) for k in p)
    assert {r.doc_id: r.n_links for r in QUERIES["op6_jaccard_join"](spark, small).collect()} == {d: want[d] for d, _ in rows}


def test_join_odd(spark):
    got = jaccard_join.jaccard_join(odd(spark)).collect()
    assert len(got) == 11
    assert {(r.class_id, r.n_links) for r in got if r.doc_id == 3} == {(3, 2)} and {(r.class_id, r.n_links) for r in got if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}
    assert jaccard_join.jaccard_join(odd(spark, [])).count() == 0


def test_recall_is_that_of_the_runs():
    assert 1 - (1 - 0.8**3) ** jaccard_join.runs_needed(0.8, 3, 0.9995) >= 0.9995
    rng, n, runs, spare = np.random.default_rng(0), 200_000, jaccard_join.runs_needed(0.8, 3, 0.9995), jaccard_join._SPARE
    equal = rng.random((n, spare)) < 0.8
    meet = (rng.random((n, runs, 3)) < 0.8).all(2)
    for _ in range(3):  # splits on three neighbouring coordinates that every run shares
        at = rng.integers(0, spare, (n, runs))
        meet &= np.any([np.take_along_axis(equal, (at + j) % spare, 1) for j in range(3)], 0)
    assert meet.any(1).mean() > 0.9994


def test_overlap_counts_shared_items():
    rng = random.Random(6)
    sets = [rng.sample(range(5000), rng.randint(0, 3000)) for _ in range(7)]
    got = jaccard_join._overlap(np.repeat(np.arange(7), [len(x) for x in sets]), np.array([i for x in sets for i in x]), 7, 100)
    assert all(got[i, j] == len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


# ---- 7 licenses


def test_template_join_is_exact(spark):
    rng = random.Random(4)
    words = [w for t in license_scan.TEMPLATES.values() for w in license_scan._words(t)]
    lines = []
    for t in license_scan.TEMPLATES.values():
        for drop in (0, 0.1, 0.2, 0.3):
            kept = [w for w in t.split() if rng.random() >= drop] + rng.choices(words, k=3)
            rng.shuffle(kept)
            lines.append(" ".join(kept))
    rows = [(i, "\n".join(rng.sample(lines, 4))) for i in range(60)]
    got = {r.doc_id: {(m.line, m.template) for m in r.matches} for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = set()
        for n, line in enumerate(text.split("\n")):
            have = set(license_scan._words(line))
            for name, t in license_scan.TEMPLATES.items():
                s = set(license_scan._words(t))
                if len(s & have) >= max(1, -(-8 * len(s) // 10)):
                    want.add((n, name))
        assert got[i] == want


def test_license_odd(spark):
    got = license_scan.license_scan(odd(spark)).collect()
    assert len(got) == 11 and all(r.labels == "" and r.score == 0 and r.first_word is None for r in got)
    assert license_scan.license_scan(odd(spark, [])).count() == 0
    one = license_scan.license_scan(odd(spark, [(1, "The MIT\nlicense, mit-license")])).first()
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == (5, 2, 1, 3, "mit")


def test_notices_over_lines(spark, tmp_path):
    wrapped = [" * " + "\n * ".join(" ".join(t.split()[i : i + 6]) for i in range(0, len(t.split()), 6)) for t in license_scan.TEMPLATES.values()]
    rows = list(enumerate([*wrapped, "x\nAll rights\nreserved. y", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0", "all the rights are reserved", "", None]))
    rows += [(100, "lead words\n" * 40 + wrapped[0] + "\ntail " * 40), (101, "\nfill in the gap here\n".join(wrapped[2].split("\n"))), (102, " ".join(f"{x} gap gap" for x in wrapped[0].replace("\n", " ").split()))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: set(r.labels.split(",")) for r in QUERIES["op7_license_notices"](spark, str(tmp_path)).collect()}
    n = len(wrapped)
    assert all(name in got[i] for i, name in enumerate(license_scan.TEMPLATES))
    assert got[n] == {"rights-reserved"} and got[n + 1] == {"cc-by-nc"} and all(got[i] == {""} for i in range(n + 2, n + 6))
    assert "mit-notice" in got[100] and "gpl-notice" not in got[101]
    assert differences(QUERIES["op7_license_notices"](spark, str(tmp_path)), ORACLE_SQL["op7_license_notices"], str(tmp_path)) == []


def test_whole_license_texts(spark, tmp_path):
    rng, texts = random.Random(9), license_scan.TEXTS
    broken = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    partly = lambda t, keep: " ".join(w for w in t.split() if rng.random() < keep)
    rows = [f"Copyright holder\n{broken(t)}\nint main;" for t in texts.values()] + [partly(t, 0.95) for t in texts.values()] + [partly(t, 0.5) for t in texts.values()]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: set(r.labels.split(",")) for r in QUERIES["op7_license_scan"](spark, str(tmp_path)).collect()}
    for i, name in enumerate(texts):
        assert name in got[i] and name in got[i + len(texts)] and name not in got[i + 2 * len(texts)]
    assert differences(QUERIES["op7_license_scan"](spark, str(tmp_path)), ORACLE_SQL["op7_license_scan"], str(tmp_path)) == []


# ---- 8 exact dedup


def test_exact_dedup_odd(spark):
    rows = exact_dedup.exact_dedup(odd(spark)).collect()
    assert len(rows) == 11
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 3, True), (None, 3, 3, False), (6, 6, 1, True)} <= got
    assert {r.text_sha256 for r in rows if r.doc_id == 6} == {hashlib.sha256("ÄÖ é　z".encode()).hexdigest()}
    assert exact_dedup.exact_dedup(odd(spark, [])).count() == 0
    key = lambda r: repr(r)
    assert sorted(exact_dedup.exact_dedup(odd(spark), block_bits=20).collect(), key=key) == sorted(rows, key=key)


# ---- 9 line dedup


def test_line_dedup_odd(spark):
    rows = [(i, f"{'Menu' if i < 12 else 'x'}\t\nbody {i}\n\nend {i % 2}") for i in range(20)] + [(20, None)]
    df = odd(spark, rows).withColumn("source", F.lit("s"))
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df, "source", "text", ratio=0.5, min_pages=5, dropped="gone").collect()}
    assert got[0] == "body 0\n\nend 0" and got[13] == "x\t\nbody 13\n\nend 1" and got[20] is None
    assert line_dedup.line_dedup(odd(spark, []), "source", "text").count() == 0
    assert line_dedup.line_dedup(odd(spark), "source", "text", broadcast_hosts=0).count() == 11


def test_line_dedup_of_small_and_large_sites(spark, tmp_path):
    hosts = {"two": 2, "three": 3, "four": 4, "large": 20}
    rows = [(f"{h}{i}", f"https://{h}.example/{i}", f"<p>footer</p><p>{'some' if i < 3 else 'other'}</p><p>own {h} {i}</p>") for h, n in hosts.items() for i in range(n)]
    spark.createDataFrame(rows, "page_id string, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.n_dropped for r in QUERIES["op9_small_site_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {p: 0 if p[:3] == "two" else 2 if p[:-1] in ("three", "four") and p != "four3" else 1 if p[:4] != "larg" else 2 if int(p[5:]) >= 3 else 1 for p, *_ in rows}
    got = {r.page_id: r.n_dropped for r in QUERIES["op9_site_line_dedup"](spark, str(tmp_path)).collect()}
    assert got["two0"] == got["three0"] == got["four0"] == 2 and got["large0"] == 1 and got["large5"] == 2
    for name in ("op9_site_line_dedup", "op9_small_site_line_dedup"):
        assert differences(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path)) == []


# ---- 10 packing


def test_packing_round_trip(spark, small):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    docs = table(spark, small, "documents")
    want = {r.doc_id: [*model.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, BPE).collect()
    back: dict[int, dict[int, list]] = {}
    for r in rows:
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        back.setdefault(r.doc_id, {})[r.start] = r.ids
    assert {d: [i for s in sorted(p) for i in p[s]] for d, p in back.items()} == want
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(len([r for r in rows if r.doc_id == d]) == len(w) // 2048 + bin(len(w) % 2048).count("1") for d, w in list(want.items())[:20])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "'", " ", "\n", "\t", "\r", ".", "9", "é", "退", "\u3000", "\xa0", "\x85", "\x1c", "<|endoftext|>", "'s"]), max_size=40).map("".join), min_size=1, max_size=5), st.integers(1, 20))
def test_encoder_gives_the_ids_of_the_library(texts, most):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    ids, counts = packing.Encoder(BPE).encode(*textvec.text_bytes(pa.array(texts, pa.large_string())), most)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_of_texts_that_end_in_white_space(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    ends = ["", " ", "  ", "\n", "\n\n", " \n", "\t\t", "\r\n\r\n", "\xa0 ", "　　", "  <|endoftext|>", "<|endoftext|>\n\n"]
    texts = [f"{a}{word}{b}" for word in ("", "c", "a b") for a in ends for b in ends]
    got: dict[int, list] = {}
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), BPE).orderBy("doc_id", "start").collect()
    for r in rows:
        got.setdefault(r.doc_id, []).extend(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert got == {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_encoder_compares_bytes_where_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(packing, "mix", np.zeros_like)
    texts = ["abc def ghi", "abc def ghj", "", "xyz\n\n", "abc"]
    encoder = packing.Encoder(BPE)
    for part in (texts, texts[3:]):
        ids, counts = encoder.encode(*textvec.text_bytes(pa.array(part, pa.large_string())))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encoder.model.encode(t) for t in part]


def test_packing_odd(spark):
    rows = packing.buckets(packing.pack(odd(spark), BPE)).collect()
    assert [(r.start, r.length, r.ids) for r in rows if r.doc_id == 2] == [(0, 1, [1])] and len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(odd(spark, []), BPE).count() == 0


# ---- pipeline


def assert_lines_of_sources(docs, got, ratio=0.05, least=5):
    """What the line stage makes of these documents, line by line; gives the number of lines that go."""
    rows = [(r.doc_id, r.source, (r.text or "").split("\n")) for r in docs.collect()]
    pages, holds = Counter(s for _, s, _ in rows), Counter((s, b) for _, s, x in rows for b in {y.strip(" \t\r") for y in x} if b)
    bad = {k for k, n in holds.items() if n >= least and n > ratio * pages[k[0]]}
    left = {d: [y for y in x if (s, y.strip(" \t\r")) not in bad] for d, s, x in rows}
    want = {d: "\n".join(left[d] if any(y.strip(" \t\r") for y in left[d]) else x) for d, _, x in rows}
    assert {r.doc_id: r.text for r in got.collect()} == want
    return sum(len(x) - len(left[d]) for d, _, x in rows)


def test_pipeline_drops_lines_on_documents(spark):
    import corpus_pipeline as cp

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert assert_lines_of_sources(docs, cp.drop_boilerplate(spark, docs, "/root/testdata/sf0.01")) > 0


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    docs = table(spark, small, "documents")
    clean = cp.drop_toxic(spark, docs, small)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    lines = cp.drop_boilerplate(spark, docs, small)
    assert_lines_of_sources(docs, lines)
    assert lines.columns == docs.columns and lines.where("n_chars <> length(text)").count() == 0 and lines.count() == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label = {d: d for d, _ in rows}
    for i, j in brute_pairs(rows):
        a, b = label[rows[i][0]], label[rows[j][0]]
        label = {d: min(a, b) if x in (a, b) else x for d, x in label.items()}
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, small).collect()) == sorted(set(label.values()))
    assert cp.mix_sources(spark, docs, small).columns == docs.columns
    assert cp.run(spark, small).count() > 0


def test_pipeline_drops_lines_of_a_source(spark, small):
    import corpus_pipeline as cp

    rows = [(i, f"own {i}\n" + "repeated\n" * (i % 10 == 0) + "rare\n" * (i % 25 == 1) + f"end {i}", "en", "ab"[i % 2], 0) for i in range(400)]
    rows += [(1000 + i, f"repeated\nfew {i}", "en", "c", 0) for i in range(4)]
    rows += [(2000 + i, "all of\nthis text\nis copied", "en", "a", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.drop_boilerplate(spark, docs, small).collect()}
    assert got == {i: t.replace("repeated\n", "") if i < 1000 else t for i, t, *_ in rows}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(None, "A b c"), (3, "a b c"), (None, None), (None, "x y z")], [(3, "a b c"), (None, None), (None, "x y z")]),
        ([(3, "a b c"), (3, "a b c"), (5, "A b c")], [(3, "a b c")]),
        ([(1, "a b c"), (7, "a b c"), (7, "x y z")], [(1, "a b c"), (7, "x y z")]),
        ([(None, "a b c"), (None, "a b c"), (None, "a b c")], [(None, "a b c")]),
        ([(-5, "x"), (2, "a b c"), (-4, "a b c"), (None, "")], [(-5, "x"), (-4, "a b c"), (None, "")]),
    ],
    ids=["null id with a copy", "repeated rows", "id with two texts", "null ids alone", "order of ids"],
)
def test_pipeline_near_copies_by_row(spark, small, rows, want):
    import corpus_pipeline as cp

    out = cp.drop_near_copies(spark, odd(spark, rows), small)
    assert out.columns == odd(spark, []).columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))


def test_pipeline_stages_odd(spark, small):
    import corpus_pipeline as cp

    for rows in ([], None):
        docs = odd(spark, rows)
        for _, stage in cp.STAGES:
            out = stage(spark, docs, small)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert rows is None or docs.count() == 0


# ---- samples, hot values and long pages


def test_samples_take_rows_not_keys(spark):
    df = spark.range(500_000).select((F.col("id") % 100).alias("doc_id"), F.lit("t").alias("text"), F.lit(0).alias("every"))
    for seed in range(4):
        assert abs(bounded_sample(df, "every", "doc_id", 2000, seed).count() - 2000) < 250
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert abs(bounded_sample(nulls, "every", "doc_id", 2000).count() - 2000) < 250


def test_languages_of_a_dirty_column(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, F.concat(F.lit("x"), F.col("id"))).otherwise(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("lang"), F.when(F.col("id") % 2 == 0, "lorem ipsum").otherwise("der und die").alias("text"))
    langs, model = language_id.train(df)
    assert len(langs) == 64 and {"a", "b"} <= set(langs) and model.shape[1] == 64


def test_toxicity_scores_by_plain_python(spark, small):
    """A table's scores are the sums of the weights of its texts' distinct words."""
    docs = table(spark, small, "documents")
    model = toxicity.train(docs, table(spark, small, "labels"))
    weights, bias = model
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect()}
    for r in docs.collect():
        slots = {int(textvec.hash_word(w.decode(), textvec.LETTERS)) & (len(weights) - 1) for w in set(re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode()))}
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-50, min(50, bias + sum(float(weights[s]) for s in slots)))))) < 1e-5


def test_long_equal_pages(spark):
    """Two pages of many lines, all but one of them equal, and a third without them."""
    lines = [f"line {i}" for i in range(20_000)]
    rows = [("h", "\n".join([*lines, "own", "", "line 3"])), ("h", "\n".join([*lines, "other"])), ("h", "x\nline 5"), (None, "line 5")]
    began = time.monotonic()
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "host string, text string"), "host", "text", dropped="n").collect()
    assert sorted((r.n, r.text) for r in got) == [(0, "line 5"), (1, "x"), (20_000, "other"), (20_001, "own\n")]
    assert time.monotonic() - began < 30


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("的一是中国人日本語カタкириλ한글abcXYZ'sreล้า9=.é"), min_size=30, max_size=400), st.sampled_from([24, 60, 150]))
def test_long_texts_without_cuts_are_encoded_in_pieces(text, most):
    encoder = packing.Encoder(BPE)
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, _ = encoder.encode(raw, np.array([0, len(raw)]), most)
    assert ids.tolist() == encoder.model.encode(text, allowed_special="all")


def test_seams_are_found_in_long_runs_of_letters():
    encoder, seen = packing.Encoder(BPE), []
    text = "".join(random.Random(2).choices("的一是中国人在有我他这为之大来以个上们到说时要就出会可也你对生能而子", k=200_000)) + "<|endoftext|>"
    plain, encoder._ids = encoder._ids, lambda raw: seen.append(len(raw)) or plain(raw)
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, n = encoder.encode(raw, np.array([0, len(raw)]), 1 << 16)
    assert max(seen) <= 1 << 16 and len(seen) >= 9 and ids.tolist() == encoder.model.encode(text, allowed_special="all") and n.tolist() == [len(ids)]
