from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleyworks.functions import text as tx
from parleyworks.operators import classify, evaluate, gates, retrieve, telemetry


def test_knowledge_gate(spark):
    rows = [(None, "order"), ("  ", "order"), ("anything", "chat"), ("x", "order"), (" Hello ", "none"), ("abc", "none"), ("pay", "none"), ("abcd", "none")]
    df = spark.createDataFrame(rows, "t string, l string")
    c = gates.needs_knowledge(F.col("t"), F.col("l"), ["chat"], ["order"], ["hello"], ["pay"])
    assert [r[0] for r in df.select(c).collect()] == [False, False, False, True, False, False, True, True]


def test_clarification_and_escalation(spark):
    df = spark.createDataFrame([("abc", "other", 0.4), ("ab ", "other", 0.4), ("abc", "other", 0.5), ("abc", "x", 0.1), (None, "other", 0.1)], "t string, l string, c double")
    assert [r[0] for r in df.select(gates.needs_clarification(F.col("t"), F.col("l"), F.col("c"))).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([("To a HUMAN", 1, "x"), ("-", 4, "x"), ("-", 3, "handoff"), (None, 3, "x")], "t string, u int, l string")
    assert [r[0] for r in df.select(gates.escalates(F.col("t"), F.col("u"), F.col("l"), ["human"], ["handoff"])).collect()] == [True, True, True, False]


def test_param_problems(spark):
    cases = [
        ('{"q": "a", "n": 3}', ""),
        ('{"q": "a", "n": true}', ""),
        ('{"q": "a", "n": 3.5}', "n is no integer"),
        ('{"q": "a", "n": null}', "n is no integer"),
        ('{"q": 1}', "q is no string"),
        ('{"n": "3"}', "missing q"),
        ('{"q": "a", "xs": [1], "o": {}, "more": 1}', ""),
        ('{"q": "a", "xs": {}}', "xs is no array"),
        ('{"q": "a", "o": []}', "o is no object"),
        ("no json", "missing q"),
        (None, "missing q"),
    ]
    types = {"q": "string", "n": "integer", "xs": "array", "o": "object"}
    df = spark.createDataFrame([(p,) for p, _ in cases], "p string")
    assert [r[0] for r in df.select(gates.param_problem(F.col("p"), ["q"], types)).collect()] == [w for _, w in cases]


def test_merge_branches(spark):
    rows = [
        (1, 0, "tech", False, True, "t", False),
        (1, 1, "bill", True, True, "b", True),
        (1, 2, "gen", False, False, "g", False),
        (2, 0, "tech", True, False, None, False),
        (3, 0, "tech", True, True, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, o int, agent string, is_primary boolean, ok boolean, content string, escalate boolean")
    got = {r.k: (r.response, r.escalated) for r in classify.merge_branches(df, "k", "o", "sorry").collect()}
    assert got == {1: ("[bill - primary]\nb\n\n[tech - supporting]\nt", True), 2: ("sorry", False), 3: ("sorry", None)}


def test_rerank(spark):
    hits = spark.createDataFrame([(k, p, f"{k}{p}") for k, n in (("a", 4), ("b", 4), ("c", 2), ("d", 4), ("e", 4)) for p in range(n)], "k string, place int, item string")
    orders = spark.createDataFrame([("a", [3, 3, 9, -1, 0, 1]), ("b", None), ("c", [1, 0]), ("d", [])], "k string, order array<int>")
    got: dict[str, list] = {}
    for r in retrieve.rerank(hits, orders, "k", 3).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append(r.item)
    # a repeated place repeats its hit; an empty order leaves nothing; without an order the first three stay
    assert got == {"a": ["a3", "a3", "a0"], "b": ["b0", "b1", "b2"], "c": ["c0", "c1"], "e": ["e0", "e1", "e2"]}


def test_knn_within(spark):
    rng = np.random.default_rng(3)
    vecs = rng.integers(0, 3, (60, 4)).astype(float)  # many ties
    keys = [None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 4}" for i in range(60)]
    df = spark.createDataFrame([(i, keys[i], vecs[i].tolist()) for i in range(60)], "id long, key string, vec array<double>").repartition(4)
    got: dict[int, list] = {}
    for r in retrieve.knn_within(df.withColumnRenamed("id", "q_id"), df, 3, block=16).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.id)
    want = {}
    for q in range(60):
        near = sorted((round(float(((vecs[i] - vecs[q]) ** 2).sum()), 6), i) for i in range(60) if i != q and keys[q] is not None and keys[i] == keys[q])
        if near:
            want[q] = [i for _, i in near[:3]]
    assert got == want
    assert retrieve.knn_within(df.withColumnRenamed("id", "q_id").limit(0), df).count() == 0


def test_fallback_gauge_best(spark):
    df = spark.createDataFrame([(True, 1.0, 9.0), (False, 1.0, 9.0), (False, 1.0, None), (None, 1.0, 9.0)], "ok boolean, r double, f double")
    got = [tuple(r[0]) for r in df.select(telemetry.with_fallback(F.col("r"), F.col("ok"), F.col("f"), F.lit("e"))).collect()]
    assert got == [(1.0, True, ""), (9.0, True, "e"), (None, False, "e"), (9.0, True, "e")]
    calls = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 6.0), ("b", 0, 0, None)], "k string, at int, tie int, v double")
    assert {r.k: (r.v, r.samples) for r in telemetry.gauge(calls, "k", ["at", "tie"], "v").collect()} == {"a": (6.0, 2), "b": (None, 1)}
    stats = spark.createDataFrame([("p", 2, 0.5), ("p", 1, 0.5), ("p", 0, 0.1)], "g string, i int, s double")
    assert [tuple(r) for r in telemetry.best_instance(stats, "g", "i", "s").collect()] == [("p", 1, 0.5)]


def test_suggestions(spark):
    tools = spark.createDataFrame([("x", 3), ("x", 3), ("y", 2)], "key string, streak long")
    agents = spark.createDataFrame([(f"a{i}", 11, 0.5) for i in range(7)] + [("few", 10, 0.1), ("well", 50, 0.85)], "key string, total long, success_rate double")
    got = [tuple(r) for r in telemetry.suggestions(tools, agents).collect()]
    assert got == [("tool x failed 3 times in a row", 9)] + [(f"agent a{i} has a low success rate", 8) for i in range(4)]


def test_feedback_by_loop(spark):
    rng = random.Random(5)
    rows = [(k, t, n, rng.randint(0, n), float(rng.randint(0, 9000) * n)) for k in "ab" for t in range(6) for n in (rng.randint(1, 9),)]
    df = spark.createDataFrame(rows, "key string, tick int, total long, success long, sum_ms double")
    got = {(r.key, r.tick): (r.penalty, r.score) for r in telemetry.feedback(df, "key", "tick").collect()}
    for k in "ab":
        total = good = 0
        ms = penalty = 0.0
        for key, t, n, s, x in rows:
            if key != k:
                continue
            total, good, ms = total + n, good + s, ms + x
            rate, mean = good / total, ms / total
            score = (0.7 * rate + 0.3 / (1 + mean / 1000)) * (1 - penalty)
            assert np.allclose(got[k, t], (penalty, score))
            penalty = min(0.9, (min(0.5, (0.9 - rate) * 2) if rate < 0.9 else 0) + (min(0.4, (mean - 3000) / 10000) if mean > 3000 else 0))


def test_recommend_json_and_cache_key(spark):
    rules = [("a", 0.9, "A"), ("b", 0.75, "B")]
    df = spark.createDataFrame([(0.1, 0.1), (0.9, 0.7), (None, 0.75)], "a double, b double")
    assert [r[0] for r in df.select(evaluate.recommend(rules, "fine")).collect()] == [["A", "B"], ["B"], ["fine"]]
    df = spark.createDataFrame([('so {"a":\n{"b": 1}} end',), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.json_body(F.col("t"))).collect()] == ['{"a":\n{"b": 1}}', "", None]
    turn = lambda i, c: (f"role{i}", c)
    rows = [("m", [turn(i, "c") for i in range(4)]), ("m", [turn(9, "old")] + [turn(i, "c") for i in range(1, 4)]), ("m", []), (None, []), ("m" * 200 + "x", []), ("m" * 200 + "y", [])]
    df = spark.createDataFrame(rows, "t string, h array<struct<role: string, content: string>>")
    k = [r[0] for r in df.select(tx.cache_key(F.col("t"), F.col("h"))).collect()]
    assert k[0] == k[1] and k[4] == k[5] and len(set(k)) == 4


@pytest.mark.parametrize("part", [2, 7, 50, 10_000])
def test_windows_in_parts_by_loop(spark, part):
    """Running totals, streaks, sessions and z-scores of hot, small and null keys do not depend on how keys are cut."""
    rng = random.Random(part)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, -30, *range(0, 600, 3)]), rng.random() < 0.4, rng.choice([1.0, 2.0, 3.0, 90.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, key string, at long, ok boolean, ms double").repartition(5)
    order = ["at", "id"]
    totals = {r.id: (r.n, r.sum) for r in telemetry.running_totals(df, "key", order, {"n": F.lit(1), "sum": F.col("ms")}, part).collect()}
    streaks = {r.id: r.streak for r in telemetry.failure_streaks(df, "key", order, part).collect()}
    session = {r.id: r.session for r in telemetry.sessions(df, "key", "at", "id", 9, part).collect()}
    odd = {r.id: r.z for r in telemetry.rolling_zscore(df, "key", order, "ms", window=10, least=5, limit=1.5, rows=part).collect()}
    resolved = {r.id: r.resolved_at for r in telemetry.resolutions(df, "key", order, part).collect()}
    want_odd = {}
    for key in ("hot", "a", None):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        streak = number = 0
        for i, (row, _, at, ok, ms) in enumerate(mine):
            streak = 0 if ok else streak + 1
            number += i > 0 and at is not None and mine[i - 1][2] is not None and at - mine[i - 1][2] >= 9
            assert totals[row] == (i + 1, sum(r[4] for r in mine[: i + 1]))
            assert (streaks[row], session[row]) == (streak, number)
            assert resolved[row] == next((r[2] for r in mine[i + 1 :] if r[3] and r[2] is not None), None)
            last = [r[4] for r in mine[max(0, i - 9) : i + 1]]
            if len(last) >= 5 and np.std(last, ddof=1) > 0 and (z := abs(ms - np.mean(last)) / np.std(last, ddof=1)) > 1.5:
                want_odd[row] = z
    assert odd.keys() == want_odd.keys() and all(np.isclose(odd[k], want_odd[k]) for k in odd)


def test_penalties_and_metrics_text(spark):
    s = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 0.0), ("c", 1.0, 0.0), (None, 1.0, 0.0)], "key string, success_rate double, avg_ms double")
    p = spark.createDataFrame([("a", 2.0), ("b", -1.0)], "key string, penalty double")
    assert {r.key: (r.penalty, round(r.score, 9)) for r in telemetry.penalised(s, p, "key").collect()} == {"a": (0.9, 0.1), "b": (0.0, 1.0), "c": (0.0, 1.0), None: (0.0, 1.0)}
    df = spark.createDataFrame([('x"\\\n', 3), (None, 4)], "tool string, n long")
    assert [r[0] for r in df.select(telemetry.exposition("n", {"tool": F.col("tool"), "le": F.lit("5")}, F.col("n"))).collect()] == ['n{tool="x\\"\\\\\\n",le="5"} 3', 'n{tool="",le="5"} 4']


def test_a_hot_key_is_cut_by_its_rows(spark):
    """A key whose rows lie in one hour is cut into parts of about as many rows; small keys are not."""
    df = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("key"), (F.col("id") * 17_000).alias("at"))
    cuts = {r["__of"]: len(r["__cuts"]) for r in telemetry.cut_points(df, "key", "at", 20_000).collect()}
    assert cuts == {"hot": 8}
    blocked, _ = telemetry._blocked(df, "key", "at", 20_000)
    sizes = {(r["key"], r["__block"]): r["count"] for r in blocked.groupBy("key", "__block").count().collect()}
    assert sizes["small", 0] == 20_000 and len(sizes) == 10 and all(abs(n - 20_000) < 1000 for (k, _), n in sizes.items() if k == "hot")
    assert telemetry.cut_points(df, "key", "at", 1_000_000) is None
