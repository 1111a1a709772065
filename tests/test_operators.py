from __future__ import annotations

import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parleyworks.functions import text as tx
from parleyworks.functions import vectors
from parleyworks.jobs.queries import QUERIES
from parleyworks.operators import classify, evaluate, memory, retrieve, skills, telemetry
from parleyworks.sources import evaluation, stores
from parleyworks.sources.skills import read_knowledge, read_skills, refused_knowledge
from parleyworks.streaming import stateful


def pack(text: str, size: int, joiner: str = "。") -> list[str]:
    """Chunks of a text, by a plain loop."""
    if len(text) <= size:
        return [text] if text.strip() else []
    out, cur = [], ""
    for s in text.replace("。", "\n").split("\n"):
        if not s.strip():
            continue
        if len(cur) + len(s) + 1 > size:
            out += [cur] if cur else []
            cur = s
        else:
            cur = cur + joiner + s if cur else s
    return out + ([cur] if cur else [])


def test_chunks(spark):
    rng = random.Random(1)
    texts = ["", "  ", "短い。", *("".join(rng.choice("ab 。\n退") for _ in range(rng.randint(0, 90))) for _ in range(60)), "x" * 70]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", tx.chunks(F.col("t"), 20).alias("c")).collect()}
    assert got == {i: pack(t, 20) for i, t in enumerate(texts)}


def test_chunk_query_keeps_all_text(spark, small):
    rows = QUERIES["chunk_documents"](spark, small).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("chunk", r"[.\s]", ""))).alias("n"))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.length(F.regexp_replace("text", r"[.\s]", "")).alias("want"))
    assert rows.join(docs, "doc_id").where("n <> want").count() == 0


def test_strip_truncate_tail(spark):
    r = spark.range(1).select(tx.strip(F.lit("\t a　\n")).alias("a"), tx.truncate(F.lit("ab  cd"), 4).alias("b"), tx.tail(F.array(), 3).alias("c"), tx.tail(F.array(F.lit(1), F.lit(2)), 1).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("a", "ab\n...", [], [2])


def test_entities(spark):
    r = spark.range(1).select(*[c.alias(k) for k, c in tx.entities(F.lit("Order: A83921 on 2024-01-02, 12.5 USD, error 500. #A83921 报500错 ¥ 30 订单号ab_12 明天 CAFÉ")).items()]).first()
    assert (r.order_id, r.date, r.amount, r.error_code) == (["A83921", "ab_12"], ["2024-01-02", "明天"], ["12.5 USD", "¥ 30"], ["A83921", "USD", "500"])


def test_keyword_tiers_and_ties(spark):
    d = [("a", 1, ["x", "y"]), ("b", 0, ["z"]), ("c", 0, ["z"])]
    df = spark.createDataFrame([("x y",), ("X z",), ("-",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(classify.best_label(classify.keyword_hits(F.col("t"), d))).collect()]
    assert got[:3] == [("a", 0.75), ("b", 0.5), ("other", 0.0)]


def test_vote_override(spark):
    legs = spark.createDataFrame([(1, 1, 0.7, "query", 0.8), (1, 3, 0.1, "refund", 0.75), (2, 1, 0.7, "refund", 0.3), (3, 1, 0.7, "refund", 1.0)], "id int, leg int, weight double, label string, confidence double")
    got = {r.id: (r.label, round(r.confidence, 6)) for r in classify.vote(legs, "id", generic=["query"]).collect()}
    assert got == {1: ("refund", 0.75), 2: ("other", 0.21), 3: ("refund", 0.7)}


def test_vote_in_any_order_of_rows(spark):
    """0.35, 0.1 and 0.05 add up to 0.5 in one order and to less in another."""
    legs = [(1, 0.7, "refund", 0.5), (2, 0.2, "refund", 0.5), (3, 0.1, "refund", 0.5)]
    rows = [(i, *leg) for i, order in enumerate(itertools.permutations(legs)) for leg in order] + [(6, 1, 0.7, "refund", None)]
    df = spark.createDataFrame(rows, "id int, leg int, weight double, label string, confidence double").coalesce(1)
    got = {r.id: (r.label, r.confidence) for r in classify.vote(df, "id").collect()}
    assert got == {i: ("refund", 0.5) for i in range(6)} | {6: ("refund", None)}


def compacted(n: int, at: int, keep: int) -> dict[int, int | None]:
    """The compaction that takes each of ``n`` rows, by appending one after another."""
    live, batch, where = [], 0, dict.fromkeys(range(n))
    for i in range(n):
        live.append(i)
        if len(live) >= at:
            gone, live = live[: len(live) - keep], live[len(live) - keep :]
            where |= dict.fromkeys(gone, batch)
            batch += 1
    return where


@pytest.mark.parametrize("at, keep", [(15, 5), (5, 2), (3, 0), (19, 18), (7, 6)])
def test_compaction_against_appending(spark, at, keep):
    sizes = [0, 1, at - 1, at, at + 1, 40, 119]
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "k int, i int")
    got = {(r.k, r.i): r.batch for r in memory.compact(df, ["k"], ["i"], at, keep).collect()}
    assert got == {(n, i): b for n in sizes for i, b in compacted(n, at, keep).items()}


def test_compaction_stream(spark, tmp_path):
    rows = [(k, i, f"t{i}") for k, n in (("a", 3), ("b", 12), (None, 7)) for i in range(n)]
    for part in (0, 1):
        half = spark.createDataFrame([r for r in rows if (r[1] < 4) == (part == 0)], "k string, i int, t string")
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, i int, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.compaction(src, "k", "i", "t", 5, 2).writeStream.format("memory").queryName("compaction").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(k, b, "\n".join(f"t{i}" for i, x in compacted(n, 5, 2).items() if x == b), 3) for k, n in (("b", 12), (None, 7)) for b in range((n - 2) // 3)}
    assert {tuple(r) for r in spark.table("compaction").collect()} == want


def test_compact_and_budget(spark):
    df = spark.createDataFrame([(1, i, "x" * 10) for i in range(9)], "k int, i int, t string")
    assert {r.i: r.batch for r in memory.compact(df, ["k"], ["i"], 5, 2).collect()} == {i: (i // 3 if i < 6 else None) for i in range(9)}
    got = [r.t for r in memory.within_budget(df, ["k"], ["i"], "t", budget=27, each=8).orderBy("i").collect()]
    assert got == ["x" * 8 + "\n...", "x" * 8 + "\n...", "\n..."]


def simulate(calls, threshold, recovery):
    fails, opened, out = 0, None, []
    for at, ok in calls:
        if opened is not None and at - opened < recovery:
            out.append("rejected")
        elif ok:
            fails, opened = 0, None
            out.append("closed")
        else:
            fails += 1
            trip = opened is not None or fails >= threshold
            opened = at if trip else None
            out.append("opened" if trip else "failed")
    return out


def test_breaker_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, 10 * i + k, rng.random() < 0.4) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, at long, ok boolean")
    want = {(k, at): o for k in range(3) for (_, at, _), o in zip([r for r in rows if r[0] == k], simulate([(r[1], r[2]) for r in rows if r[0] == k], 3, 45), strict=True)}
    got = telemetry.circuit_breaker(df.withColumn("tie", F.lit(0)), "k", "at", "tie", "ok", 3, 45)
    assert {(r.k, r["at"]): r.outcome for r in got.collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.circuit_breaker(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "at", "ok", 3, 45)
    q = stream.writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r["at"]): r.outcome for r in spark.table("breaker").collect()} == want


def test_states_of_null_and_large_keys(spark):
    big = 1 << 53
    df = spark.createDataFrame([(k, i, False) for k in (None, big, big + 1) for i in range(3)], "k long, at long, ok boolean").withColumn("tie", F.lit(0))
    got = sorted(((r.k or 0, r["at"], r.outcome) for r in telemetry.circuit_breaker(df.repartition(1), "k", "at", "tie", "ok", 2, 100).collect()))
    assert got == [(k, i, o) for k in (0, big, big + 1) for i, o in enumerate(("failed", "opened", "rejected"))]


def test_stream_sessions_and_ticks(spark, small, tmp_path):
    ev = spark.read.parquet(f"{small}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    top = ev.agg(F.max("ts")).first()[0]
    begun = Window.partitionBy("user_id").orderBy("ts")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(begun)) >= 86_400_000_000).cast("int"), F.lit(1))
    sessions = ev.withColumn("new", new).withColumn("s", F.sum("new").over(begun)).groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.count("*").alias("n"), F.max("ts").alias("last"))
    sessions = sessions.where(F.col("last") + F.expr("interval 24 hours") - F.expr("interval 1 microsecond") <= F.lit(top) - F.expr("interval 1 hour")).select("user_id", "start", "n")
    ticks = ev.groupBy("user_id", F.window("ts", "10 seconds").alias("w")).count().where(F.col("w.end") <= F.lit(top) - F.expr("interval 1 minute")).select("user_id", F.col("w.start").alias("tick"), F.col("count").alias("n"))
    for name, df, want in (("s", stateful.session_counts(src(), "user_id", "ts"), sessions), ("t", stateful.ticks(src(), "user_id", "ts", "value"), ticks)):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.table(name).select(want.columns).collect()}
        assert got and got == {tuple(r) for r in want.collect()}


def test_ttl_cache(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 5, True), (1, 11, False), (1, 12, True)], "k int, at long, ok boolean").withColumn("tie", F.col("at"))
    assert [r.outcome for r in telemetry.ttl_cache(df, "k", "at", "tie", "ok", 10).orderBy("at").collect()] == ["missed", "stored", "hit", "missed", "stored"]


def test_reports_with_zero_denominators(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a")], "t string, p string")
    got = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in evaluate.per_class(df, "t", "p").collect()}
    assert got == {"a": (1, 0, 1, 1.0, 0.5, 2 / 3), "b": (0, 1, 0, 0.0, 0.0, 0.0)}
    assert tuple(evaluate.overall(df.limit(0), "t", "p").first()) == (0.0, 0.0)


def test_skills_and_knowledge(spark, tmp_path):
    (tmp_path / "s" / "refunds").mkdir(parents=True)
    (tmp_path / "s" / "refunds" / "SKILL.md").write_text('---\nname: "Refunds"\nkeywords: a, b\nenabled: no\n---\n# Refunds\nBody')
    (tmp_path / "s" / "x.json").write_text('{"instructions": "Do"}')
    (tmp_path / "s" / "z1.json").write_text('{"name": "Z", "content": "c", "enabled": "no", "keywords": "p, q", "agents": ["Billing", ""]}')
    (tmp_path / "s" / "z2.json").write_text('[{"content": "c"}]')
    (tmp_path / "s" / "z3.json").write_text('{"name": "n"}')
    (tmp_path / "s" / "z4.md").write_text("\n ---\nagents: Billing, TECH\nname: old\nname: 'new'\n---\n#new\nText")
    (tmp_path / "s" / "z5.md").write_text("intro\n##Title\nmore")
    (tmp_path / "s" / "y.txt").write_text("---\nname: n\nopen")
    (tmp_path / "s" / "empty.md").write_text("---\nname: e\n---\n")
    (tmp_path / "s" / "README.md").write_text("no")
    good, bad = read_skills(spark, str(tmp_path / "s"))
    rows = good.collect()
    assert [(r.name, r.keywords, r.enabled, r.content) for r in rows] == [("Refunds", ["a", "b"], False, "Body"), ("x", [], True, "Do"), ("y", [], True, "---\nname: n\nopen"), ("Z", ["p", "q"], False, "c"), ("new", [], True, "Text"), ("Title", [], True, "intro\n##Title\nmore")]
    assert {r.name: r.agents for r in rows if r.agents} == {"Z": ["billing"], "new": ["billing", "tech"]}
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("empty.md", "no body"), ("z2.json", "no JSON object"), ("z3.json", "no content or instructions")]
    assert [r.path.rsplit("/", 1)[1] for r in refused_knowledge(spark, str(tmp_path / "s" / "*"), 60).collect() if r.bytes <= 60] == []
    (tmp_path / "s" / "large.md").write_text("x" * 61)
    assert [(r.path.rsplit("/", 1)[1], r.bytes, r.reason) for r in refused_knowledge(spark, str(tmp_path / "s" / "l*"), 60).collect()] == [("large.md", 61, "larger than 60 bytes")]
    assert read_knowledge(spark, str(tmp_path / "s" / "large.md"), 60).count() == 0 and read_knowledge(spark, str(tmp_path / "s" / "large.md"), 61).count() == 1
    (tmp_path / "k.json").write_text('[{"title": "t"}, {"content": "c"}]')
    (tmp_path / "a.b.md").write_text("text")
    assert [tuple(r) for r in read_knowledge(spark, str(tmp_path / "k.json")).collect()] == [("t", ""), ("", "c")]
    assert [tuple(r) for r in read_knowledge(spark, str(tmp_path / "a.b.md")).collect()] == [("a.b", "text")]


# ---- vectors, votes, skills, neighbours, stores -------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3) if i % 7 else None, rng.integers(0, 4, 6 if i % 5 else 4).astype(float).tolist()) for i in range(400)]
    rows[11], rows[12] = (11, 1, None), (12, 0, [1.0, None, 2.0, 0.0, 0.0, 1.0])
    df = spark.createDataFrame(rows, "id long, key int, vec array<double>").repartition(5)
    asked = df.where("id % 20 = 0 or id in (11, 12)").withColumnRenamed("id", "q_id")
    ok = [r for r in rows if r[2] and None not in r[2]]

    def brute(keyed):
        for q, key, v in ok:
            if q % 20 == 0:
                near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, x)), 6), i) for i, k, x in ok if i != q and len(x) == len(v) and (not keyed or (k == key and k is not None)))
                yield from ((q, n + 1, i, d) for n, (d, i) in enumerate(near[:4]))

    for options in ({}, {"block": 16, "broadcast_blocks": 0, "spread": 3}):
        got = retrieve.knn(asked.drop("key"), df.drop("key"), 4, **options).collect()
        assert sorted((r.q_id, r["rank"], r.id, r.distance) for r in got) == sorted(brute(False))
    assert sorted((r.q_id, r["rank"], r.id, r.distance) for r in retrieve.knn_within(asked, df, 4).collect()) == sorted(brute(True))
    assert retrieve.knn(asked.drop("key").limit(0), df.drop("key")).count() == 0 and retrieve.knn(asked.drop("key"), df.drop("key").limit(0)).count() == 0


def test_vectors_and_templates(spark):
    df = spark.createDataFrame([(1, " Refund ME "), (2, ""), (3, None), (4, "退款")], "i int, t string")
    sparse = vectors.sparse_vectors(df, "t").where("i = 4").collect()
    assert (220, 1) in {(r.slot, r.value) for r in sparse} and len({r.i for r in vectors.sparse_vectors(df, "t").collect()}) == 4
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in vectors.dense_vectors(df, "t", "v").collect())
    got = {r.i: (r.match.label, round(r.match.confidence, 6)) for r in vectors.best_template(df, "t", [("a", ["invoice"]), ("b", ["pay", "refund me"]), ("c", ["refund me"])]).collect()}
    assert got[1] == ("b", 1.0) and all(0 <= c <= 1 for _, c in got.values())
    assert vectors.best_template(df, "t", []).first().match.label == "other"


def test_vote_of_a_row(spark):
    leg = "struct<leg:int,weight:double,label:string,confidence:double,failed:boolean>"
    cases = {
        "fallback to vectors": ([(1, 0.7, "other", 0.0, True), (2, 0.2, "b", 0.3, False), (3, 0.1, "c", 0.9, False)], ("b", 0.3)),
        "fallback to patterns": ([(1, 0.7, "other", 0.0, True), (2, 0.2, "other", 0.3, False), (3, 0.1, "c", 0.9, False)], ("c", 0.9)),
        "nothing": ([(1, 0.7, "other", 0.0, True), (2, 0.2, "b", 0.0, False), (3, 0.1, "other", 0.9, False)], ("other", 0.0)),
        "sum": ([(1, 0.7, "a", 0.5, False), (2, 0.2, "b", 1.0, False), (3, 0.1, "a", 1.0, False)], ("other", 0.45)),
        "tie": ([(1, 0.5, "z", 1.0, False), (2, 0.5, "a", 1.0, False), (3, 0.0, "a", 0.0, False)], ("z", 0.5)),
        "override": ([(1, 0.7, "g", 1.0, False), (2, 0.2, "g", 0.0, False), (3, 0.1, "s", 0.75, False)], ("s", 0.75)),
        "sure": ([(1, 0.7, "g", 1.0, False), (2, 0.2, "g", 0.6, False), (3, 0.1, "s", 0.75, False)], ("g", 0.82)),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], f"name string, legs array<{leg}>")
    got = df.select("name", classify.vote_row(F.col("legs"), ["g"], ["s"]).alias("v")).collect()
    assert {r.name: (r.v.label, round(r.v.confidence, 9)) for r in got} == {k: w for k, (_, w) in cases.items()}
    r = spark.range(1).select(classify.label_group(F.lit("refund"), {"refund": "billing"}).alias("a"), classify.label_group(F.lit("x"), {"refund": "billing"}).alias("b"), classify.known_label(F.lit("x"), ["y"]).alias("c")).first()
    assert tuple(r) == ("billing", "x", "other")


def test_route_of_a_request(spark):
    rows = [("a", 4, "query", 0.2), ("b", 1, "handoff", 0.9), ("c", 1, "handoff", 0.1), ("d", 1, "fix", 0.6)]
    df = spark.createDataFrame(rows, "text string, urgency int, label string, c double")
    rules = [("general", 0.1, [], 0.0, ["zz"], 0.1, 0.3), ("technical", 0.0, ["fix"], 0.75, ["zz"], 0.1, 0.3)]
    scores = classify.domain_scores(F.col("text"), F.col("label"), rules, [("technical", F.col("text") == "d", 0.2)])
    got = {r.text: tuple(r.r) for r in df.select("text", classify.route_request(scores, F.col("urgency"), F.col("label"), F.col("c"), ["handoff"]).alias("r")).collect()}
    assert got == {"a": ("escalation", "", 1.0, "general"), "b": ("escalation", "", 0.9, "general"), "c": ("escalation", "", 0.8, "general"), "d": ("technical", "", 0.95, "technical")}


def test_skills_within_a_budget(spark):
    table = spark.createDataFrame(
        [(0, "all", "", [], [], True, "x" * 30), (1, "b", "d", ["Key"], ["billing"], True, "y" * 50), (2, "off", "", [], [], False, "z"), (3, "c", None, [], [], True, "w" * 40)],
        "ord int, name string, description string, keywords array<string>, agents array<string>, enabled boolean, content string",
    )
    asked = spark.createDataFrame([(1, "a KEY word", "Billing"), (2, "a key", "tech"), (3, None, None), (4, "key", "")], "i int, message string, agent string")
    got = {r.i: (r.skills, r.prompt) for r in skills.match_skills(asked, table, "message", "agent", budget=60, each=35).collect()}
    blocks = ["### all\n" + "x" * 30, "### b\n说明: d\n" + "y" * 35 + "\n...", "### c\n" + "w" * 35 + "\n..."]

    def fold(names):
        parts, left = [], 60
        for n in names:
            b = blocks["abc".index(n)]
            b = b if len(b) <= left else b[:left].rstrip() + "\n..."
            parts, left = [*parts, b], left - len(b)
            if left <= 0:
                break
        return "\n\n".join(parts)

    assert got == {1: (["all", "b"], fold("abc")), 2: (["all", "c"], fold("ac")), 3: (["all", "c"], fold("ac")), 4: (["all", "b"], fold("abc"))}
    with pytest.raises(ValueError):
        skills.match_skills(asked, table, "message", "agent", most=3)


def test_replies_and_cases(spark):
    blocks = F.from_json(F.lit('[{"type": "text", "text": "a"}, {"type": "tool", "text": "b"}, {"text": "c"}, {"type": "text", "text": ""}]'), "array<struct<type:string,text:string>>")
    r = spark.range(1).select(
        tx.reply_text(blocks).alias("a"),
        tx.json_list(F.lit("so [1, 2] or [3]")).alias("b"),
        tx.dialog_turns(F.array(F.lit("x"), F.lit(" ")), F.lit("q")).alias("c"),
        tx.dialog_turns(F.lit(None).cast("array<string>"), F.lit("q")).alias("d"),
        tx.dialog_turns(F.lit(None).cast("array<string>"), F.lit("")).alias("e"),
        tx.sayable(F.unhex(F.lit("61FF62"))).alias("f"),
    ).first()
    assert tuple(r) == ("a\nc", "[1, 2] or [3]", ["x"], ["q"], [], "ab")


def test_stores(spark, tmp_path):
    path = str(tmp_path / "chunks")
    docs = spark.createDataFrame([("t", "a。" * 400), ("u", "short"), ("u", "short"), ("v", " ")], "title string, content string")
    n = stores.seed_when_empty(docs, path)
    rows = stores.chunk_table(spark, path).read()
    assert n == stores.chunk_rows(docs).count() and rows.count() == n - 1 and rows.select("chunk_id").distinct().count() == n - 1
    assert stores.seed_when_empty(docs, path) == 0 and stores.add_chunks(docs, path) == n and stores.chunk_table(spark, path).read().count() == n - 1
    log = spark.createDataFrame([("a", 0), ("a", 50), ("b", 10)], "k string, at long")
    assert {r.k for r in stores.live_log(log, ["k"], "at", 100, 60).collect()} == {"a"}
    assert [tuple(r) for r in stores.upsert_profiles(spark.createDataFrame([("a", 2, "new")], "k string, at int, p string"), spark.createDataFrame([("a", 1, "old")], "k string, at int, p string"), ["k"], ["at"]).collect()] == [("a", 2, "new")]


def test_templates_are_added_once(spark, tmp_path):
    path = str(tmp_path / "templates")
    first = spark.createDataFrame([("refund", "a"), ("refund", "a"), ("query", "a")], "label string, text string")
    stores.add_templates(first, path)
    stores.add_templates(spark.createDataFrame([("refund", "b"), ("query", "a")], "label string, text string"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("query", "a"), ("refund", "a"), ("refund", "b")]


def test_evaluation_runs(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"id": "1", "query": "q", "expected_intent": "refund"}, {"id": "2", "history": [{"role": "user", "content": "c"}]}]')
    cases = evaluation.read_cases(spark, str(tmp_path / "cases.json")).orderBy("id").collect()
    assert cases[0].expected_intent == "refund" and cases[0].history is None and cases[1].history[0].content == "c"
    (tmp_path / "labels.json").write_text('{"intent_labels": ["refund", "query"], "specific_intents": ["refund"], "intent_groups": {"refund": "billing"}}')
    assert {tuple(r) for r in evaluation.read_label_groups(spark, str(tmp_path / "labels.json")).collect()} == {("refund", "billing", True), ("query", "query", False)}
    (tmp_path / "base.json").write_text('{"timestamp": "2024-01-01", "total": 4, "passed": 3, "pass_rate": 0.75, "avg_scores": {"relevance": 0.9, "accuracy": 0.5}}')
    base = evaluation.read_baseline(spark, str(tmp_path / "base.json"))
    path = str(tmp_path / "runs")
    assert evaluation.store_run(base, path).count() == 0
    results = spark.createDataFrame([("a", True, {"relevance": 0.8, "accuracy": 0.6}), ("b", False, {"relevance": 0.8, "accuracy": None})], "test_id string, passed boolean, scores map<string,double>")
    fell = evaluation.store_run(evaluation.report(results, "2024-01-02"), path).collect()
    assert [(r.metric, r.value, r.previous, round(r.delta, 4)) for r in fell] == [("relevance", 0.8, 0.9, -0.1111)]
    assert {(r.total, r.passed, r.pass_rate) for r in spark.read.parquet(path).where("run = '2024-01-02'").collect()} == {(2, 1, 0.5)}


def test_known_ngrams_are_small_and_right():
    """300,000 n-grams that a task has hashed take a few MB; what is forgotten is hashed again."""
    hashes = vectors._Hashes(256)
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0xE001, 1 << 17, 300_000).astype(np.uint64) | (rng.integers(0x30, 0x3000, 300_000).astype(np.uint64) << np.uint64(21)))
    tracemalloc.start()
    codes = np.concatenate([hashes.of(part) for part in np.array_split(keys, 40)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 8 << 20
    few, mixed = vectors._Hashes(256, keep=1000), np.sort(rng.choice(len(keys), 3000, False))
    for at in (mixed[::3], mixed[::2], mixed[:100], mixed, mixed[::3]):
        assert few.of(keys[at]).tolist() == hashes.of(keys[at]).tolist() == codes[at].tolist()
        assert len(few.known) <= 1000
    for key, code in zip(keys[:200].tolist(), codes[:200].tolist(), strict=True):
        digest = hashlib.md5("".join(chr((key >> at & (1 << 21) - 1) - 1) for at in (0, 21) if key >> at & (1 << 21) - 1).encode()).digest()
        assert code == 2 * (int.from_bytes(digest[:4], "big") % 256) + digest[4] % 2
