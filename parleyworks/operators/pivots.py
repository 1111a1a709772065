"""Exact nearest neighbours that leave out what the triangle inequality rules out.

``build`` makes an index of a corpus: pivots are the centres of k-means on a bounded sample of ``sample`` rows, a row belongs to the cell of
its nearest pivot, and the rows of a cell lie in blocks of ``rows`` vectors in the order of their distance to the pivot. A cell has a count and a radius, a
block the least and the largest distance to the pivot. There are at most ``cells`` cells, so their table is the driver's and goes to every task; every row of the corpus is in a block.

``search`` goes over the index twice. First a query meets its nearest cells, as many as hold ``k`` other rows; the distance of the
k-th row found is a bound. Then it meets the further cells that may hold a nearer row (its distance to the pivot less the radius is within
the bound), and of these only the blocks whose ring about the pivot reaches within the bound. A cell's rows and a cell's queries are dealt in
parts, so a cell with a third of all rows is many tasks.

Distances are squared Euclidean ones to six digits and ties go to the smaller id, as in ``retrieve.knn``. The pivots change what is compared
and never the result. Null vectors, and those with a null in them or of another length than the index, have no neighbours and are none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written
from .retrieve import _Best, _near

_DIGITS = 2e-6  # what rounding to six digits and the order of sums can move a squared distance by


@dataclass
class Index:
    """``blocks`` (cell, least, most, n, ids, vecs), and by cell the pivots, counts and radii."""

    blocks: DataFrame
    pivots: np.ndarray
    counts: np.ndarray
    radii: np.ndarray


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def centres(x: np.ndarray, cells: int, steps: int = 8, seed: int = 0) -> np.ndarray:
    """k-means centres of ``x``, empty ones left out."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(steps):
        near = np.argmin(_distances(x, c), 1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = sums[n > 0] / n[n > 0, None]
    return c


def _whole(df: DataFrame, dims: int) -> DataFrame:
    return df.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()) & (F.size("vec") == dims))


def build(corpus: DataFrame, cells: int | None = None, sample: int = 20_000, rows: int = 1024) -> Index | None:
    """The index of ``corpus`` (id, vec); None where no row has a vector. Its length is that of most vectors."""
    spark = corpus.sparkSession
    lengths = corpus.where("vec is not null").groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None or not lengths["dims"]:
        return None
    dims, n = lengths["dims"], lengths["count"]
    whole = _whole(corpus, dims).select(F.col("id").cast("long").alias("id"), "vec")
    share = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < F.lit(min(1 << 30, math.ceil(sample / n * (1 << 30))))
    taken = whole.where(share).select("vec").limit(2 * sample).collect() or whole.select("vec").limit(1).collect()
    if not taken:
        return None
    pivots = centres(np.array([r["vec"] for r in taken], np.float64), min(4096, cells or math.ceil(math.sqrt(n))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dims)
                d = _distances(x, pivots)
                cell = np.argmin(d, 1)
                exact = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(exact), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "cell", "d", "vec"])

    assigned = written(whole.mapInArrow(assign, "id long, cell int, d double, vec binary"), "cells")
    counts, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect():
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    parts = F.element_at(F.lit((counts // (64 * rows) + 1).tolist()), F.col("cell") + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, cell, d, vecs = zip(*held, strict=True)
            made = [[cell[0]], [d[0]], [d[-1]], [len(ids)], [np.array(ids, "<i8").tobytes()], [b"".join(vecs)]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "least", "most", "n", "ids", "vecs"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (row[1] != held[0][1] or row[2] < held[-1][2] or len(held) == rows):
                    yield out()
                held.append(row)
        if held:
            yield out()

    dealt = assigned.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long"))).repartition("cell", "part").sortWithinPartitions("cell", "part", "d")
    blocks = written(dealt.select("id", "cell", "d", "vec").mapInArrow(pack, "cell int, least double, most double, n long, ids binary, vecs binary"), "blocks")
    return Index(blocks, pivots, counts, radii)


def _asked(queries: DataFrame, index: Index, need: int, further: bool) -> DataFrame:
    """(cell, q_id, d, tau, vec): the cells that a query goes to first, or those that it goes to then."""
    pivots, counts, radii, dims = index.pivots, index.counts, index.radii, index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            d = _distances(x, pivots)
            order = np.argsort(d, 1, kind="stable")
            before = np.cumsum(counts[order], 1) - counts[order]
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, before < need, 1)
            first &= counts > 0
            tau = batch.column(2).to_numpy(zero_copy_only=False)
            wanted = (d - radii <= tau[:, None] + 1e-6 * (1 + d)) & ~first & (counts > 0) if further else first
            q, cell = np.nonzero(wanted)
            if len(q):
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).take(at), pa.array(d[q, cell]), pa.array(tau[q]), pa.array([x[i].tobytes() for i in q], pa.binary())], ["cell", "q_id", "d", "tau", "vec"])

    return _whole(queries, dims).select(F.col("q_id").cast("long").alias("q_id"), "vec", "tau").mapInArrow(run, "cell int, q_id long, d double, tau double, vec binary")


def _meet(asked: DataFrame, index: Index, k: int, skip_self: bool, rows: int = 256) -> DataFrame:
    """(q_id, id, distance, compared): the ``k`` nearest rows of each task, and a row without id that has the number of comparisons."""
    dims = index.pivots.shape[1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            order = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.diff(cell[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                for lo in range(0, len(at), rows):
                    part = batch.take(pa.array(at[lo : lo + rows]))
                    values = [[int(cell[at[0]])], *([part.column(i).to_numpy().tobytes()] for i in (1, 2, 3)), [b"".join(part.column(4).to_pylist())]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["cell", "q_ids", "q_d", "q_tau", "q_vecs"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, compared = _Best(k), {}
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, d, tau = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_d"]), np.frombuffer(row["q_tau"])
                slack = tau + 1e-6 * (1 + d)
                use = np.flatnonzero((d - slack <= row["most"]) & (d + slack >= row["least"]))
                if not len(use):
                    continue
                own, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vecs"]).reshape(-1, dims)
                asked, q = q_ids[use], np.frombuffer(row["q_vecs"]).reshape(-1, dims)[use]
                same = asked[:, None] == own[None, :] if skip_self else np.zeros((len(asked), len(own)), bool)
                a, b, distance = _near(q, x, same, k)
                best.add(asked[a], own[b], distance)
                for i in asked.tolist():
                    compared[i] = compared.get(i, 0) + len(own)
        q, i, distance = best.top()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(distance), pa.array(np.zeros(len(q), np.int64))], ["q_id", "id", "distance", "compared"])
        yield pa.RecordBatch.from_arrays([pa.array(list(compared), pa.int64()), pa.nulls(len(compared), pa.int64()), pa.nulls(len(compared), pa.float64()), pa.array(list(compared.values()), pa.int64())], ["q_id", "id", "distance", "compared"])

    dealt = asked.repartition("cell", F.pmod(F.xxhash64("q_id"), F.lit(8)))
    packs = dealt.mapInArrow(pack, "cell int, q_ids binary, q_d binary, q_tau binary, q_vecs binary")
    return index.blocks.join(packs, "cell").drop("cell", "n").mapInArrow(near, "q_id long, id long, distance double, compared long")


def search(queries: DataFrame, index: Index | None, k: int = 5, skip_self: bool = True) -> DataFrame:
    """(q_id, id, distance, rank, compared) of the ``k`` rows of the index nearest to each of ``queries`` (q_id, vec); ``compared`` is the number of rows that the query met."""
    if index is None:
        return queries.sparkSession.createDataFrame([], "q_id long, id long, distance double, rank int, compared long")
    asked = queries.select("q_id", "vec")
    first = written(_meet(_asked(asked.withColumn("tau", F.lit(math.inf)), index, k + skip_self, False), index, k, skip_self), "first-hits")
    by_distance = Window.partitionBy("q_id").orderBy("distance", "id")
    kth = first.where("id is not null").withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") == k)
    bound = kth.select("q_id", F.sqrt(F.col("distance") + F.lit(_DIGITS)).alias("tau"))
    bounded = asked.join(bound, "q_id", "left").withColumn("tau", F.coalesce("tau", F.lit(math.inf)))
    hits = first.unionByName(_meet(_asked(bounded, index, k + skip_self, True), index, k, skip_self))
    met = hits.withColumn("compared", F.sum("compared").over(Window.partitionBy("q_id"))).where("id is not null")
    return met.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
