"""Running loops and stores that several writers share."""

from __future__ import annotations

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from parleyworks.jobs import corpora
from parleyworks.operators import memory, telemetry
from parleyworks.sources import skills
from parleyworks.sources.commits import Table
from parleyworks.streaming import collector, stateful


def test_collector_as_feedback_in_batch(spark, tmp_path):
    """Scores and penalties of a stream are those of the batch form, also when a tick runs again; alerts open and are resolved once."""
    rng = random.Random(3)
    schema = "key string, ok boolean, ms double"
    ticks = [[(k, rng.random() < (0.2 if t < 3 and k == "a" else 1.0), float(rng.randrange(20, 120))) for k in ("a", "b", None) for _ in range(rng.randrange(1, 30)) if (k, t) != ("b", 2)] for t in range(6)]
    ticks[4] += [("a", True, 1.0)] * 600
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for t, rows in enumerate(ticks):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for f in os.listdir(source):
            if f.endswith(".parquet") and os.path.getmtime(f"{source}/{f}") > 10_000:
                os.utime(f"{source}/{f}", (1000 + t, 1000 + t))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    limits = {"slow": 45, "scale": 100, "least_rate": 0.9, "most_ms": 60}

    def results():
        scores = spark.read.parquet(f"{path}/scores").select("key", "batch", "total", F.round("penalty", 9), F.round("score", 9))
        alerts = spark.read.parquet(f"{path}/alerts").select("key", "metric", "opened", "resolved", "batch")
        return sorted(map(repr, scores.collect())), sorted(map(repr, alerts.collect())), alerts

    collector.run(stream(), path, "key", None, **limits).awaitTermination(300)
    scores, alerts, table = results()
    every = [(k, t, ok, ms) for t, rows in enumerate(ticks) for k, ok, ms in rows]
    df = spark.createDataFrame(every, "key string, batch int, ok boolean, ms double").groupBy("key", "batch").agg(F.count("*").alias("total"), F.sum(F.col("ok").cast("int")).alias("success"), F.sum("ms").alias("sum_ms"))
    want = telemetry.feedback(df, "key", "batch", slow=45, scale=100)
    want = want.withColumn("total", F.sum("total").over(telemetry.Window.partitionBy("key").orderBy("batch"))).select("key", "batch", "total", F.round("penalty", 9), F.round("score", 9))
    assert scores == sorted(map(repr, want.collect()))
    opened = {(r.key, r.opened) for r in table.where("metric = 'success_rate' and resolved is null").collect()}
    resolved = {(r.key, r.opened, r.resolved) for r in table.where("metric = 'success_rate' and resolved is not null").collect()}
    assert ("a", 0) in opened and ("a", 0, 4) in resolved

    commits = f"{path}/checkpoint/commits"
    for f in (f"{commits}/5", f"{commits}/.5.crc"):  # as if the last tick had failed after its writes
        if os.path.exists(f):
            os.remove(f)
    spark.createDataFrame([("a", True, 5.0)], schema).coalesce(1).write.mode("append").parquet(source)
    collector.run(stream(), path, "key", None, **limits).awaitTermination(300)
    again = spark.read.parquet(f"{path}/scores").where("batch <= 5").select("key", "batch", "total", F.round("penalty", 9), F.round("score", 9))
    assert sorted(map(repr, again.collect())) == scores
    assert spark.read.parquet(f"{path}/scores").where("batch = 6").count() == 1
    assert sorted(f for f in os.listdir(f"{path}/state") if f.startswith("batch")) == ["batch=5", "batch=6"]


# ---- tables with commits

SCHEMA = "id string, at int, t string"


def rows_of(df):
    return sorted(map(tuple, df.select("id", "at", "t").collect()))


def test_table_adds_and_upserts(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert table.version() == 0 and table.read().count() == 0 and table.add(make([])) == 0
    assert table.add(make([("a", 1, "x"), ("b", 1, "x"), ("a", 2, "w"), (None, 1, "n")])) == 1
    assert table.add(make([("a", 9, "later"), ("c", 1, "z")])) == 2
    assert table.add(make([("c", 9, "later")])) == 2
    assert rows_of(table.read().where("id is not null")) == [("a", 1, "x"), ("b", 1, "x"), ("c", 1, "z")]
    assert table.upsert(make([("a", 0, "old"), ("b", 1, "tie"), ("c", 5, "new"), ("d", 1, "d"), ("d", 2, "e")]), ["at"]) == 3
    assert rows_of(table.read().where("id is not null")) == [("a", 1, "x"), ("b", 1, "tie"), ("c", 5, "new"), ("d", 2, "e")]
    assert rows_of(table.read(1).where("id is not null")) == [("a", 1, "x"), ("b", 1, "x")]


def test_two_writers_store_each_id_once(spark, tmp_path):
    path = str(tmp_path / "t")
    failed = []

    def write(no):
        try:
            Table(spark, path, SCHEMA, ["id"], buckets=4).add(spark.createDataFrame([(f"k{i}", no, "x") for i in range(no, no + 20)], SCHEMA))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(no,)) for no in (0, 5, 10, 15)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = Table(spark, path, SCHEMA, ["id"], buckets=4)
    assert not failed and table.version() == 4
    assert sorted(r.id for r in table.read().collect()) == sorted(f"k{i}" for i in range(35))


def test_a_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)
    table.add(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    with pytest.raises(Exception, match="broken"):
        table.upsert(spark.createDataFrame([("a", 2, "y"), ("b", 2, "y")], SCHEMA).withColumn("t", F.raise_error(F.lit("broken")).cast("string")), ["at"])
    monkeypatch.setattr(table, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.add(spark.createDataFrame([("b", 2, "y")], SCHEMA))
    assert rows_of(Table(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4).read()) == [("a", 1, "x")]


def test_compaction_stream_expires(spark, tmp_path):
    """A log that nothing is pushed to for a day dies, in the stream as in the batch form, and leaves no state."""
    rng = random.Random(9)
    hour = 3_600_000_000
    rows, at = [], dict.fromkeys("abc", 0)
    for i in range(120):
        k = rng.choice("abc")
        at[k] += rng.choice((1, 2, 30)) * hour if rng.random() < 0.1 else hour
        rows.append((k, i, f"t{i}", at[k]))
    df = spark.createDataFrame(rows, "k string, i int, t string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    source = str(tmp_path / "in")
    last = max(r[3] for r in rows)
    stages = [df.where("i < 60"), df.where("i >= 60"), spark.createDataFrame([("z", 999, "z", last + 96 * hour)], "k string, i int, t string, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")]
    for n, part in enumerate(stages):
        part.coalesce(1).write.mode("append").parquet(source)
        for f in os.listdir(source):
            if f.endswith(".parquet") and os.path.getmtime(f"{source}/{f}") > 10_000:
                os.utime(f"{source}/{f}", (1000 + n, 1000 + n))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    made = stateful.compaction(stream, "k", "i", "t", 6, 2, ts="ts", late="1000 hours")
    q = made.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    begun = telemetry.sessions(df.withColumn("us", F.unix_micros("ts")), "k", "us", "i", 24 * hour)
    since = F.min("ts").over(telemetry.Window.partitionBy("k", "session")).alias("since")
    want = memory.compact(begun.select("k", "i", "t", "session", since), ["k", "session"], ["i"], 6, 2).where("batch is not null")
    want = want.groupBy("k", "since", "batch").agg(memory.ordered_concat(F.col("i"), F.col("t"), "\n").alias("text"))
    got = sorted(map(tuple, spark.table("expiring").select("k", "since", "batch", "text").collect()))
    assert got == sorted(map(tuple, want.collect())) and len({(r[0], r[1]) for r in got}) > 3

    short = stateful.compaction(stream, "k", "i", "t", 6, 2, ts="ts", late="1 hour")
    q = short.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal == 1  # of z alone, whose day has not passed


# ---- skills as a stream, corpora as a job


def test_skills_as_a_stream(spark, tmp_path):
    root = tmp_path / "s"
    (root / "deep").mkdir(parents=True)
    (root / "deep" / "SKILL.md").write_text("---\nname: One\nkeywords: a, b\n---\nbody")
    (root / "two.json").write_text('{"name": "Two", "content": "c", "agents": ["X"]}')
    (root / "bad.json").write_text("[1]")
    path = str(tmp_path / "out")

    def take():
        q = skills.stream_skills(spark, str(root)).writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return sorted((r.name, r.reason) for r in spark.read.parquet(path).select("name", "reason").collect())

    first = take()
    assert first == [("One", None), ("Two", None), ("bad", "no JSON object")]
    (root / "three.md").write_text("# Three\ntext")
    assert [n for n, _ in take()] == ["One", "Three", "Two", "bad"]
    good, bad = skills.read_skills(spark, str(root))
    assert [(r.name, r.agents) for r in good.collect()] == [("One", []), ("Three", []), ("Two", ["x"])] and [r.reason for r in bad.collect()] == ["no JSON object"]


def test_corpora_from_files_to_a_stored_report(spark, tmp_path):
    cases = [
        {"id": "1", "query": "where is order A83921", "expected_intent": "status", "expected_group": "query", "entities": {"order_id": ["A83921"]}, "type": "standard"},
        {"id": "2", "query": "money back", "expected_intent": "refund", "expected_group": "billing", "type": "standard"},
        {"id": "3", "query": "money and order #ZZ99", "expected_intent": "refund", "expected_group": "billing", "entities": {"order_id": ["ZZ99", "none1"]}, "type": "mixed"},
        {"id": "4", "query": "hello", "expected_intent": "greeting", "expected_group": "greeting"},
    ]
    labels = {"intent_labels": ["status", "refund", "invoice"], "specific_intents": ["refund"], "intent_groups": {"status": "query", "refund": "billing", "invoice": "billing"}}
    routes = [{"id": "r1", "query": "money", "expected_primary_domain": "billing", "expected_supporting_domains": ["technical"]}, {"id": "r2", "query": "x", "expected_primary_domain": "general"}]
    for name, value in (("i", cases), ("l", labels), ("r", routes)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    store = str(tmp_path / "store")

    def run(name, money):
        label = F.when(F.contains("query", F.lit("money")), F.lit(money)).when(F.contains("query", F.lit("order")), "status").otherwise("greeting")
        route = lambda df: df.withColumns({"primary": F.when(F.contains("query", F.lit("money")), "billing").otherwise("general"), "supporting": F.array(F.lit("technical"))})
        fell = corpora.run_corpora(spark, store, name, str(tmp_path / "i.json"), str(tmp_path / "l.json"), lambda df: df.withColumn("label", label), str(tmp_path / "r.json"), route)
        return {r.metric: round(r.value, 4) for r in fell.collect()}, {r.metric: r.value for r in spark.read.parquet(f"{store}/runs").where(F.col("run") == name).collect()}

    fell, got = run("2024-01-01", "refund")
    assert not fell and got == {"accuracy": 1.0, "macro_f1": 1.0, "group_accuracy": 1.0, "entity_recall": 0.75, "type_accuracy": 1.0, "routing_accuracy": 1.0, "supporting_recall": 1.0}
    fell, got = run("2024-01-02", "invoice")
    assert got["accuracy"] == 0.5 and got["group_accuracy"] == 1.0 and fell == {"accuracy": 0.5, "macro_f1": got["macro_f1"], "type_accuracy": got["type_accuracy"]}
    one = spark.read.parquet(f"{store}/runs").where("run = '2024-01-02'").select("total", "passed").first()
    assert tuple(one) == (5, 2)  # routing and the case without a type pass
    by_label = {r.label: (r.tp, r.fp, r.fn) for r in spark.read.parquet(f"{store}/labels/run=2024-01-02").collect()}
    assert by_label == {"status": (1, 0, 0), "refund": (0, 0, 2), "invoice": (0, 2, 0), "greeting": (1, 0, 0)}
