"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else in the training folds is unlabelled
text. Several bags share the positives and each has unlabelled documents of its own. In each bag a
numpy classifier over the presence of hashed words minimises the class-prior-corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss. Where the bracket is negative, the step goes against its gradient, so the
classifier does not fit the unlabelled text's hidden positives. The bags' margins are averaged.

The sample is bounded by ``positives`` and ``unlabelled`` (documents, by a hash of the id); the
score covers every whole text.

Defined results: null text counts as empty and has the score of a text without words; without a
positive example the score is 0 for all; repeated label rows count once (toxic if any says so);
labels of absent documents and null labels are ignored; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, fold
from .textvec import LETTERS, text_bytes, text_slices, word_hashes

_BITS = 18
_MODEL = "slots array<int>, weights array<float>, bias double"


def _slots(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each distinct word of each row."""
    raw, offsets = text_bytes(text)
    h, _, counts = word_hashes(raw, offsets, LETTERS)
    key = np.repeat(np.arange(len(counts), dtype=np.int64), counts) << _BITS | (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    key = np.unique(key)
    return key >> _BITS, key & ((1 << _BITS) - 1)


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, start: np.ndarray, steps: int = 500, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk, by Adam on the full sample."""
    w, b = start.astype(np.float64), float(np.log(prior / (1 - prior)))
    p, u = x[positive], x[~positive]
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) for z in (p, u))
        dp, du = sp * (1 - sp) / max(len(p), 1), su * (1 - su) / max(len(u), 1)
        # loss of calling x positive is 1 - s, of calling it negative s
        if su.sum() / max(len(u), 1) - prior * sp.sum() / max(len(p), 1) >= 0:
            gp, gu = -prior * dp - prior * dp, du
        else:
            gp, gu = prior * dp, -du
        grad = np.r_[gp @ p + gu @ u + decay * prior * w, gp.sum() + gu.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, key, slots) from (positive, key, text): a document as its distinct words' slots."""
    for batch in batches:
        for lo, hi in text_slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            r, s = _slots(part.column(2))
            offsets = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), slots], ["positive", "key", "slots"])


def _fit_bag(group: pa.Table, prior: float, features: int = 256) -> pa.Table:
    group = group.sort_by([("positive", "ascending"), ("key", "ascending")]).combine_chunks()
    positive = group["positive"].to_numpy().astype(bool)
    n_p, n_u = positive.sum(), (~positive).sum()
    slots = group["slots"].combine_chunks()
    s = slots.flatten().to_numpy()
    r = np.repeat(np.arange(len(positive), dtype=np.int32), slots.value_lengths().to_numpy())
    in_p = np.bincount(s[positive[r]], minlength=1 << _BITS)
    in_u = np.bincount(s[~positive[r]], minlength=1 << _BITS)
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / max(n_p, 1) - in_u / max(n_u, 1)) / np.sqrt(share * (1 - share) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    chosen = np.argsort(-np.abs(z), kind="stable")[:features]
    chosen = np.sort(chosen[np.abs(z[chosen]) >= min(5.0, np.abs(z[chosen[0]]))])
    place = np.full(1 << _BITS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(positive), len(chosen)), np.float32)
    hit = place[s] >= 0
    x[r[hit], place[s[hit]]] = 1
    start = np.log((in_p[chosen] + 0.5) / (n_p + 1)) - np.log((in_u[chosen] + 0.5) / (n_u + 1))
    w, b = fit_nnpu(x, positive, prior, start)
    return pa.table({"slots": [chosen.astype(np.int32)], "weights": [w.astype(np.float32)], "bias": [b]})


def _bag_keys(spark: SparkSession, bags: int) -> list[int]:
    """A number for each bag; they hash to different partitions where there are enough, so no two bags share a task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("place")
    rows = spark.range(16 * bags).select(F.col("id").cast("int"), place).collect()
    first: dict[int, int] = {}
    for r in rows:
        first.setdefault(r["place"], r["id"])
    found = sorted(first.values())[:bags]
    return found if len(found) == bags else list(range(bags))


def train(docs: DataFrame, labels: DataFrame, bags: int = 4, positives: int = 4000, unlabelled: int = 16000, priors: tuple[float, float] = (0.01, 0.5)) -> tuple[np.ndarray, float] | None:
    """The averaged weights by slot (2**18 of them, whatever the corpus) and bias; None without positives.

    The class prior is the share of toxic rows among the labels, held within ``priors``: outside, the risk has next to no weight
    on one of its sides.
    """
    bounded_batches(docs)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("positive"))
    marks = marks.where(fold(F.col("doc_id")) != 0)
    n, n_pos = marks.agg(F.count(F.lit(1)), F.sum("positive")).first()
    if not n_pos:
        return None
    prior = min(max(n_pos / n, priors[0]), priors[1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = bounded_sample(marks.where("positive = 1").select("doc_id", "positive"), "positive", "doc_id", positives)
    p = rows.join(F.broadcast(chosen), "doc_id").select(F.lit(1).alias("positive"), F.col("doc_id").alias("key"), "text")
    u = bounded_sample(rows.withColumn("all", F.lit(0)), "all", "doc_id", unlabelled, seed=1)
    u = u.select(F.lit(0).alias("positive"), F.col("doc_id").alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = p.unionByName(u).mapInArrow(_featurise, f"positive int, key {kind}, slots array<int>")
    every = F.array(*[F.lit(i) for i in _bag_keys(docs.sparkSession, bags)])
    own = F.array(F.get(every, F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(bags)).cast("int")))
    bagged = features.withColumn("bag", F.explode(F.when(F.col("positive") == 1, every).otherwise(own)))
    models = bagged.groupBy("bag").applyInArrow(lambda group: _fit_bag(group, prior), _MODEL).collect()
    if not models or not chosen.join(rows.select("doc_id"), "doc_id", "left_semi").limit(1).count():
        return None  # no document with a positive label
    weights = np.zeros(1 << _BITS, np.float32)
    for m in models:
        weights[np.array(m["slots"], np.int64)] += np.array(m["weights"], np.float32) / len(models)
    return weights, float(np.mean([m["bias"] for m in models]))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float] | None, name: str = "toxicity") -> DataFrame:
    """``docs`` with ``name`` (double, 0 to 1) from the whole text."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    bounded_batches(docs)
    weights, bias = model
    slots = np.flatnonzero(weights)
    values = weights[slots]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << _BITS, np.float32)
        table[slots] = values
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).fill_null("")
            out = np.full(len(text), bias)
            for lo, hi in text_slices(text):
                raw, offsets = text_bytes(text.slice(lo, hi - lo))
                h, _, counts = word_hashes(raw, offsets, LETTERS)
                slot = (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                hit = np.flatnonzero(table[slot])
                row = np.searchsorted(np.cumsum(counts), hit, "right")
                key = np.unique(row << _BITS | slot[hit])
                out[lo:hi] += np.bincount(key >> _BITS, table[key & ((1 << _BITS) - 1)], hi - lo)
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50)))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{schema}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", "text")
    scored = score_toxicity(rows, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
