"""Dictionaries, vectors, keys and stores that grow: against plain Python and the forms for small ones."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parleyworks.functions import text as tx
from parleyworks.functions import vectors
from parleyworks.jobs.queries import QUERIES
from parleyworks.operators import classify, keywords, memory, pivots, retrieve, skills


@pytest.mark.parametrize("part_chars", [1 << 20, 200])
def test_keyword_pairs(spark, part_chars):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abéÉ退") for _ in range(n))
    entries = [(rng.randrange(40), rng.choice((word(rng.randrange(1, 5)), None if rng.random() < 0.1 else ""))) if rng.random() < 0.05 else (rng.randrange(40), word(rng.randrange(1, 6))) for _ in range(300)]
    texts = [(i, rng.choice((None, "", word(30), word(200).upper()))) for i in range(60)]
    df = spark.createDataFrame(texts, "k long, t string").repartition(3)
    got = keywords.keyword_pairs(df, ["k"], "t", spark.createDataFrame(entries, "id int, keyword string"), part_chars)
    want = {}
    for k, t in texts:
        for i, w in set(entries):
            if t is not None and w is not None and w in t.lower():
                want[k, i] = want.get((k, i), 0) + 1
    assert {(r.k, r.entry): r.found for r in got.collect()} == want
    assert keywords.keyword_pairs(df.limit(0), ["k"], "t", spark.createDataFrame([], "id int, keyword string"), part_chars).count() == 0


def test_pairs_leave_a_task_in_blocks():
    """A batch of 2,000 texts that meet 60 entries each is never whole in memory as pairs."""
    import ahocorasick

    rng = random.Random(9)
    words = [a + b for a in "abcd" for b in "abcd"] + ["", "zz"]
    listed = [[rng.randrange(1 << 50) for _ in range(rng.choice((1, 5)))] if w else [7, 8] for w in words]
    listed[1] = listed[0][:1] + listed[1]  # an entry of two keywords
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(words):
        if w:
            automaton.add_word(w, i)
    automaton.make_automaton()
    starts, ids = np.cumsum([0, *map(len, listed)]), np.array([x for xs in listed for x in xs])
    texts = ["".join(rng.choice("abcd") for _ in range(60)) for _ in range(2000)] + [""]
    out = list(keywords._pairs(texts, automaton, starts, ids, [words.index("")], most=500))
    assert len(out) > 100 and max(len(found) for _, _, found in out) <= 500 + len(ids)
    want = {}
    for at, t in enumerate(texts):
        for w, xs in zip(words, listed, strict=True):
            for x in xs if w in t else ():
                want[at, x] = want.get((at, x), 0) + 1
    got = [(at, x, n) for a, b, c in out for at, x, n in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
    assert len(got) == len(want) and {(at, x): n for at, x, n in got} == want


@pytest.mark.parametrize(("size", "rows"), [(10, 3), (1, 1), (1000, 1000)])
def test_blocks_of_a_batch(size, rows):
    texts = ["a" * 4, None, "", "b" * 30, "é" * 3, *"cdefgh"]
    column = pa.array(["-", *texts]).slice(1)
    got = list(tx.blocks(column, size, rows))
    assert [t for _, some in got for t in some] == texts and [lo for lo, _ in got] == np.cumsum([0, *(len(some) for _, some in got)])[:-1].tolist()
    assert all(len(some) <= rows and (len(some) == 1 or sum(len((t or "").encode()) for t in some) <= size) for _, some in got)
    assert list(tx.blocks(column.slice(0, 0))) == []


def test_fifty_thousand_keywords_as_contains(spark):
    """As many keywords as documents have words, each with its own number, meet what ``contains`` meets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("keyword")).where("keyword <> ''").distinct().limit(50_000)
    dictionary = words.withColumn("id", F.xxhash64("keyword")).cache()
    assert dictionary.count() > 40_000
    few = docs.where("doc_id % 97 = 0")
    got = keywords.keyword_pairs(few, ["doc_id"], "text", dictionary).select("doc_id", "entry")
    want = few.join(F.broadcast(dictionary), F.contains(F.lower("text"), F.col("keyword"))).select("doc_id", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dictionary_labels_as_in_a_row(spark, small):
    entries = [("a", 0, ["the", "of"]), ("b", 0, ["that"]), ("c", 1, ["is", "is", "by"])]
    df = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [(label, i, tier, k) for i, (label, tier, ks) in enumerate(entries) for k in ks]
    hits = keywords.classify(df, ["conv_id", "turn"], "text", spark.createDataFrame(rows, "label string, ord int, tier int, keyword string"))
    in_row = df.withColumn("h", classify.keyword_hits(F.col("text"), entries))
    want = in_row.select("conv_id", "turn", F.explode("h").alias("h")).select("conv_id", "turn", "h.label", "h.ord", "h.tier", "h.hits", "h.score")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    best = in_row.select("conv_id", "turn", classify.best_label(F.col("h")).alias("b")).where("b.label <> 'other'").select("conv_id", "turn", "b.label", "b.score")
    assert sorted(map(tuple, keywords.best_labels(hits, ["conv_id", "turn"]).collect())) == sorted(map(tuple, best.collect()))


def test_many_skills_as_in_a_row(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    table = [(i, f"s{i}", rng.choice((None, "", "about")), [word().upper() for _ in range(rng.choice((0, 1, 3)))], rng.choice(([], ["x"], ["x", "y"])), rng.random() < 0.8, "c" * rng.randrange(60)) for i in range(120)]
    df = spark.createDataFrame(table, "ord int, name string, description string, keywords array<string>, agents array<string>, enabled boolean, content string")
    asked = spark.createDataFrame([(i, rng.choice((None, "", "ABcabbca", "ccc", "b")), rng.choice((None, "", "X", "y", "z"))) for i in range(40)], "id int, said string, who string")
    for budget in (5000, 150, 7):
        one = skills.match_skills(asked, df, "said", "who", budget=budget, each=40, lead="> ")
        many = skills.match_skills(asked, df, "said", "who", budget=budget, each=40, lead="> ", most=10, key=["id"])
        assert sorted(map(repr, one.select(many.columns).collect())) == sorted(map(repr, many.collect()))
    with pytest.raises(ValueError, match="key"):
        skills.match_skills(asked, df, "said", "who", most=10)


def nearest(queries, corpus, k):
    out = []
    for q, v in queries:
        if v is None or None in v:
            continue
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), 6), i) for i, x in corpus if x is not None and None not in x and len(x) == len(v) and i != q)
        out += [(q, i, r + 1) for r, (_, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [3, 1024])
def test_pivots_by_brute_force(spark, rows):
    rng = random.Random(rows)
    spot = [[rng.randrange(100) for _ in range(3)] for _ in range(4)]
    corpus = [(i, [float(c + rng.choice((0, 0, 1, 2))) for c in rng.choice(spot[: 1 if i % 3 else 4])]) for i in range(300)]
    corpus += [(900, None), (901, [1.0, None, 2.0]), (902, [1.0])]
    df = spark.createDataFrame(corpus, "id long, vec array<double>").repartition(4)
    index = pivots.build(df, cells=7, sample=50, rows=rows)
    queries = [(i, v) for i, v in corpus if i % 5 == 0 and (v is None or len(v) == 3)] + [(1000, [500.0, 0.0, 1.0])]
    for k in (1, 5, 299):
        got = pivots.search(spark.createDataFrame(queries, "q_id long, vec array<double>"), index, k)
        assert sorted(map(tuple, got.select("q_id", "id", "rank").collect())) == nearest(queries, corpus, k)
    assert pivots.search(df.select(F.col("id").alias("q_id"), "vec"), pivots.build(df.limit(0))).count() == 0


def test_pivots_leave_out_most_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, (40, 16))
    x = centre[rng.integers(0, 40, 8000)] + rng.normal(0, 0.05, (8000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = df.where("id % 20 = 0").withColumnRenamed("id", "q_id")
    got = pivots.search(queries, pivots.build(df), 5).select("q_id", "id", "rank", "compared").collect()
    want = retrieve.knn(queries, df, 5).select("q_id", "id", "rank").collect()
    assert sorted((r.q_id, r.id, r.rank) for r in got) == sorted(map(tuple, want))
    compared = {r.q_id: r.compared for r in got}
    share = sum(compared.values()) / (len(compared) * len(x))
    assert share < 0.2, share


def one_by_one(sentences, size, joiner):
    done, now = [], ""
    for s in sentences:
        if len(now) + len(s) + 1 > size:
            done, now = done + [now] * (now != ""), s
        else:
            now = s if now == "" else now + joiner + s
    return done + [now] * (now != "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab退😀", min_size=1, max_size=12), max_size=30), st.integers(1, 25), st.sampled_from([".", "。", " | "]))
def test_sentences_are_packed_as_one_by_one(sentences, size, joiner):
    assert tx.pack_sentences(sentences, size, joiner) == one_by_one(sentences, size, joiner)


def test_chunks_of_a_long_text_take_linear_time(spark):
    text = "".join(f"sentence number {i}." for i in range(600_000))
    df = spark.createDataFrame([(text,), (None,), ("",), (" 　\n",), ("short",)], "t string").repartition(1).cache()
    df.count()
    began = time.monotonic()
    got = [r[0] for r in df.select(F.transform(tx.chunks(F.col("t"), delimiters=r"[.\n]", joiner="."), F.length)).collect()]
    assert time.monotonic() - began < 15
    assert None in got and [5] in got and got.count([]) == 2
    assert max(len(x or ()) for x in got) == len(tx.pack_sentences(text.split(".")[:-1], 500, "."))


def test_texts_are_cut_once(spark, small):
    """The chunks of a text become rows where it is cut; before, a filter by their number cut it a second time."""
    plan = QUERIES["chunk_documents"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(node) for node in ("ArrowEvalPython", "MapInArrow")) == 1
    texts = [None, "", " \n", "a.b", "ab.cd." * 40, "é.退\n" * 7, *("x" * i + "." for i in range(30))] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    got = tx.exploded_chunks(df, "t", 20, r"[.\n]", ".").collect()
    cut = df.select("i", tx.chunks(F.col("t"), 20, r"[.\n]", ".").alias("c")).collect()
    assert sorted(map(tuple, got)) == sorted((r.i, len(r.c), k, c) for r in cut for k, c in enumerate(r.c or ()))


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_budgets_are_kept_before_the_shuffle(spark, batch):
    rng = random.Random(6)
    rows = [(rng.choice(("hot", "hot", "a", None)), rng.choice((1, None)), i, rng.choice((None, "", "x" * rng.randrange(9), "é  " * 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, j int, i long, t string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        left = memory.first_within(df, ["k", "j"], ["i"], "t", 20).collect()
        got = memory.within_budget(df, ["k", "j"], ["i"], "t", budget=20, each=6, mark="~").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(left) <= 6 * 4 * 20 and len(left) < len(rows)
    want = []
    for key in {(r[0], r[1]) for r in rows}:
        room = 20
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            if room <= 0:
                break
            t = r[3] if r[3] is None or len(r[3]) <= 6 else r[3][:6].rstrip(" ") + "~"
            n = len(t or "")
            want.append((*r[:3], t if n <= room else t[: max(room - 1, 0)].rstrip(" ") + "~"))
            room -= n
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_hot_key_moves_a_budget_from_each_task(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("k"), "id", F.lit("ten chars.").alias("t"))
    left = memory.first_within(df, ["k"], ["id"], "t", 500)
    assert left.count() == 8 * 50
    assert memory.within_budget(df, ["k"], ["id"], "t", budget=500).count() == 50


def test_ten_thousand_templates_by_brute_force(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("ab 退É😀\x00") for _ in range(rng.randrange(12)))
    templates = [(f"l{i}", [text() for _ in range(i % 4)]) for i in range(7000)]
    asked = [text() for _ in range(40)] + [None, "", "  ", "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string").repartition(2)
    assert sum(len(x) for _, x in templates) > 10_000

    def vector(t):
        t = (t or "").lower().strip()
        v = np.zeros(256)
        for g in {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} or {""}:
            d = hashlib.md5(g.encode()).digest()
            v[int.from_bytes(d[:4], "big") % 256] += -1 if d[4] % 2 else 1
        return v

    sides = [np.array([vector(t) for t in x]) for _, x in templates]
    got = {r.i: (r.match.label, r.match.confidence) for r in vectors.best_template(df, "t", templates).collect()}
    for i, t in enumerate(asked):
        v, best = vector(t), (0.0, "other")
        for (label, _), s in zip(templates, sides, strict=True):
            c = max((float(x @ v) / n for x in s if (n := np.linalg.norm(x) * np.linalg.norm(v)) > 0), default=0.0)
            if round(c, 9) > round(best[0], 9):
                best = (c, label)
        assert got[i][0] == best[1] and abs(got[i][1] - best[0]) < 1e-9
