"""Exact nearest neighbours for a stated query set, and multi-query search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written


def _packed(df: DataFrame, id_name: str, rows: int) -> DataFrame:
    """(key, dims, ids, vecs) from (id, key, vec): up to ``rows`` vectors of one key and length in a row, as bytes.

    A null vector, or one with a null in it, is in no row.
    """
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy()
            dims = batch.column(2).value_lengths().to_numpy()
            for c, d in {*zip(code.tolist(), dims.tolist(), strict=True)}:
                at = np.flatnonzero((code == c) & (dims == d))
                for lo in range(0, len(at), rows):
                    part = batch.take(pa.array(at[lo : lo + rows]))
                    vecs = part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                    values = [part.column(1).slice(0, 1), [d], [part.column(0).to_numpy().astype("<i8").tobytes()], [vecs.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) if isinstance(v, list) else v for v, t in zip(values, (None, pa.int32(), pa.binary(), pa.binary()), strict=True)], ["key", "dims", "ids", "vecs"])

    whole = df.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).select(F.col(id_name).cast("long"), "key", "vec")
    return whole.mapInArrow(run, f"key {kind}, dims int, ids binary, vecs binary")


class _Best:
    """The ``k`` nearest of each query so far."""

    def __init__(self, k: int):
        self.k, self.found = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, q: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        self.found.append((q, i, d))
        if sum(len(x[0]) for x in self.found[1:]) > max(200_000, 2 * len(self.found[0][0])):
            self.found = [self.top()]

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        new = np.r_[True, q[1:] != q[:-1]][: len(q)]
        place = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(q) else q
        keep = place < self.k
        return q[keep], i[keep], d[keep]


def _near(q: np.ndarray, x: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that hold the ``k`` nearest, and their distances to six digits, computed one by one."""
    rough = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T
    rough[same] = np.inf
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(q), np.inf)
    a, b = np.nonzero((rough <= (limit + 2e-6 + 1e-9 * np.abs(limit))[:, None]) & ~same)
    return a, b, np.round(((x[b] - q[a]) ** 2).sum(1), 6)


def knn(
    queries: DataFrame, corpus: DataFrame, k: int = 5, block: int = 1024, skip_self: bool = True, keyed: bool = False, broadcast_blocks: int = 256, spread: int = 64
) -> DataFrame:
    """(q_id, id, distance, rank): the ``k`` rows of ``corpus`` (id, vec) nearest to each of ``queries`` (q_id, vec).

    Squared Euclidean distance to six digits; ties go to the smaller id. With ``keyed`` both have a
    ``key``, and only rows with the query's own key count; a null key has no neighbours. Vectors of
    different lengths never meet.

    Both sides are packed into rows of up to ``block`` vectors where they lie. Every packed row of the
    corpus meets the packed queries of its key: as a broadcast of up to ``broadcast_blocks`` such rows,
    beyond that by a shuffle in which the queries go to ``spread`` places, so that no key is one task.
    A task keeps one running top ``k`` for each query and gives it out once. Nothing passes through the driver.
    """
    spark = queries.sparkSession
    if not keyed:
        queries, corpus = (df.withColumn("key", F.lit(0)) for df in (queries, corpus))
    # packed rows are large: a few of them in a batch, and no more where the session asks for less
    now = re.match(r"(\d+)b?$", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if now is None or not 0 < int(now[1]) <= 16 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    # written, so what makes the queries runs once, for the check of their size and for the join
    blocks = written(_packed(queries, "q_id", block).toDF("key", "dims", "q_ids", "q_vecs"), "queries")
    slices = _packed(corpus, "id", block)
    if blocks.limit(broadcast_blocks + 1).count() <= broadcast_blocks:
        pairs = slices.join(F.broadcast(blocks), ["key", "dims"])
    else:
        salted = slices.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))
        pairs = salted.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), ["key", "dims", "salt"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for d, ids, vecs, q_ids, q_vecs in zip(*(batch.column(i) for i in range(5)), strict=True):
                own, asked = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(q_ids.as_buffer(), "<i8")
                x, q = (np.frombuffer(v.as_buffer(), "<f8").reshape(len(n), d.as_py()) for v, n in ((vecs, own), (q_vecs, asked)))
                same = asked[:, None] == own[None, :] if skip_self else np.zeros((len(asked), len(own)), bool)
                a, b, distance = _near(q, x, same, k)
                best.add(asked[a], own[b], distance)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.top()], ["q_id", "id", "distance"])

    found = pairs.select("dims", "ids", "vecs", "q_ids", "q_vecs").mapInArrow(near, "q_id long, id long, distance double")
    w = Window.partitionBy("q_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def multi_query(hits: DataFrame, key: str, content: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` of the hits (query_no, rank, content) of a key's sub-queries, equal contents once, in query order."""
    w = Window.partitionBy(key, *content).orderBy("query_no", "rank")
    once = hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    best = once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("query_no", "rank")))
    return best.where(F.col("place") <= k)


def knn_within(queries: DataFrame, corpus: DataFrame, k: int = 5, **options) -> DataFrame:
    """``knn`` among the rows with the query's own ``key``: (q_id, key, vec) against (id, key, vec); ids of queries are distinct."""
    return knn(queries, corpus, k, keyed=True, **options).join(queries.select("q_id", "key"), "q_id")


def rerank(hits: DataFrame, orders: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The hits (key, place from 0) in the order that a model gave, as ``rank`` from 1 to ``k``.

    ``orders`` (key, order) lists places, best first. Places outside the list are passed over and a
    repeated place repeats its hit. A key with ``k`` hits or fewer keeps its own order; without an
    order (null or absent, a failed model) the first ``k`` stay.
    """
    sized = hits.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    asked = sized.join(orders.select(key, "order"), key, "left")
    plain = (F.col("__n") <= k) | F.col("order").isNull()
    own = F.when(plain, F.array(F.col("place").cast("int")))
    given = F.transform(F.filter(F.col("order"), lambda p: (p >= 0) & (p < F.col("__n"))), lambda p: p.cast("int"))
    spots = F.filter(F.transform(given, lambda p, i: F.when(p == F.col("place"), i)), lambda i: i.isNotNull())
    out = asked.withColumn("__at", F.explode(F.coalesce(own, spots))).where(F.col("__at") < k)
    return out.withColumn("rank", F.col("__at") + 1).drop("__n", "__at", "order")
