"""N-gram Jaccard self-join by chosen paths.

Documents are sets of hashed five-word shingles, A-Z lower-cased; documents with equal sets are one member with a
number of copies. Sets are embedded by minhash, so that a coordinate is a token sampled from the
set and two sets share it with probability equal to their similarity.

A run starts at a root and follows ``depth`` sampled tokens; the members with the same path are a
node. Nodes of one member end there. Nodes of up to ``limit`` members are brute-forced. Larger ones
are split again on sampled tokens, ``branches`` of them so that similar members keep meeting; a
node whose members share most tokens (its largest child has over half of them) would not shrink and
is brute-forced at once; so is a node that is still large after ``rounds`` splits. Runs repeat until
a pair at the threshold meets with probability ``recall``, splits included. Nodes with the same
members are brute-forced once.

A node goes to tasks in pairs of blocks. A block has about ``block`` members and ``block_tokens``
shingles, so a task holds two of these, and beside them only its longest document.

Texts are hashed once for their signatures. Only those whose set meets another one are hashed
again, and each set goes straight to its buckets, once from every task that reads a copy of it.

A brute-forced bucket returns, for each member with a link, the number of linked documents and one
edge towards the smallest member it is connected with, never its pairs. A pair that meets in several
nodes counts in the smallest of them. Connected members form a class, found by rounds of
min-label propagation with pointer jumping over written tables, until nothing changes.

Defined results: texts without a word (null, empty) have no set, no links and a class of their own;
texts with fewer than five words have one shingle of all of them; copies of a set link with each
other; a row that repeats an id is a copy like any other; the class is the smallest ``doc_id`` of
its documents (null where all are null); a very long text is one value of eight bytes a word, in
the one or two tasks that compare it; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, semi_join, settle, small_enough
from .textvec import NONSPACE, mix, shingle_sets, text_bytes, text_slices, word_hashes

_SPARE = 24  # coordinates kept for further splits


def runs_needed(threshold: float, depth: int, recall: float, branches: int = 3, rounds: int = 3) -> int:
    """Runs until two sets at the threshold meet with probability ``recall``, also where their nodes are split in every round.

    One run more than independent splits would need, as the runs share the splits' coordinates.
    """
    meet = threshold**depth * (1 - (1 - threshold) ** branches) ** rounds
    return math.ceil(math.log(1 - recall) / math.log(1 - meet)) + (rounds > 0)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(text: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """For each slice: rows, shingle hashes row by row, their number by row, and the 128-bit ids of the sets."""
    for lo, hi in text_slices(text):
        words, _, counts = word_hashes(*text_bytes(text.slice(lo, hi - lo)), NONSPACE)
        h, n = shingle_sets(words, counts, shingle)
        view, ends = memoryview(h).cast("B"), 8 * np.cumsum(n)
        ids = [hashlib.blake2b(view[b - 8 * k : b], digest_size=16).digest() if k else None for b, k in zip(ends, n, strict=True)]
        yield lo, hi, h, n, ids


def signatures(docs: DataFrame, shingle: int, runs: int, depth: int) -> DataFrame:
    """(doc_id, text_key, set_id, size, nodes, spare): the set of every row, its shingles, its root node in each run, and its coordinates for splits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    by = _multipliers(runs * depth + _SPARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, n, ids in _sets(batch.column(2), shingle):
                some, m = np.flatnonzero(n), hi - lo
                low = np.zeros((m, len(by)), np.uint64)
                if len(some):
                    starts = (np.cumsum(n) - n)[some]
                    for i, a in enumerate(by):
                        low[some, i] = np.minimum.reduceat(mix(h * a), starts)
                node = np.tile(np.arange(1, runs + 1, dtype=np.uint64), (m, 1))
                for d in range(depth):
                    node = mix(node * np.uint64(0x9E3779B97F4A7C15) + low[:, d * runs : (d + 1) * runs])
                spare = low[:, runs * depth :].astype("<u4")
                part = batch.slice(lo, m)
                nodes = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * runs, runs, dtype=np.int32)), pa.array(node.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(n.astype(np.int64)), nodes, pa.array([x.tobytes() for x in spare], pa.binary())],
                    ["doc_id", "text_key", "set_id", "size", "nodes", "spare"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, set_id binary, size long, nodes array<long>, spare binary")


def _children(nodes: DataFrame, branches: int) -> DataFrame:
    """(node, set_id, size, parent, parent_n): (node, set_id, size, n, spare) split on ``branches`` tokens that the node samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            spare = np.stack([np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(4)]).astype(np.uint64)
            parent = batch.column(0).to_numpy().view(np.uint64)
            rows = np.arange(n)
            out = []
            for j in range(branches):
                pick = (mix(parent + np.uint64(j // _SPARE + 1)) + np.uint64(j)) % np.uint64(_SPARE)
                out.append(mix(mix(parent + np.uint64(j + 7)) + spare[rows, pick.astype(np.int64)]))
            again = pa.array(np.tile(rows, branches))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), *(batch.column(i).take(again) for i in (1, 2, 0, 3))], ["node", "set_id", "size", "parent", "parent_n"]
            )

    return nodes.select("node", "set_id", "size", "n", "spare").mapInArrow(run, "node long, set_id binary, size long, parent long, parent_n long")


def _shared(rows: DataFrame, broadcast_nodes: int) -> DataFrame:
    """``rows`` (node, ...) with the number ``n`` of members of their node, where it is two or more."""
    sizes = settle(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node-sizes")
    return rows.join(F.broadcast(sizes) if small_enough(sizes, broadcast_nodes) else sizes, "node")


def chosen_paths(members: DataFrame, coordinates: DataFrame, limit: int, branches: int, rounds: int, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """(node, set_id, n, tokens): the nodes to brute-force, one of those with the same members, with their members and shingles in all."""
    now = settle(_shared(members.select(F.explode("nodes").alias("node"), "set_id", "size"), broadcast_nodes), "nodes")
    done = [now.where(F.col("n") <= limit)]
    large = now.where(F.col("n") > limit)
    for _ in range(rounds):
        if large.isEmpty():
            break
        keys = settle(large.select("set_id").distinct(), "large-sets")
        spare = semi_join(coordinates.select("set_id", "spare"), keys, ["set_id"], broadcast_nodes).groupBy("set_id").agg(F.first("spare").alias("spare"))
        split = settle(_children(large.join(spare, "set_id"), branches), "children")
        shared = settle(_shared(split, broadcast_nodes), "split-nodes")
        top = shared.groupBy("parent", "parent_n").agg(F.max("n").alias("top"))
        dense = settle(top.where("2 * top > parent_n").select("parent"), "dense")
        done.append(large.join(dense.withColumnRenamed("parent", "node"), "node", "left_semi"))
        now = shared.join(dense, "parent", "left_anti").select("node", "set_id", "size", "n")
        done.append(now.where(F.col("n") <= limit))
        large = now.where(F.col("n") > limit)
    done.append(large)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    every = settle(every.select("node", "set_id", "size", "n"), "paths")
    h = F.xxhash64("set_id")
    content = every.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum(h % (1 << 30)).alias("a"), F.bit_xor(h).alias("b"), F.sum("size").alias("tokens"))
    kept = settle(content.groupBy("m", "a", "b").agg(F.min(F.struct("node", "tokens")).alias("one")).select("one.node", "one.tokens"), "kept-nodes")
    return every.join(F.broadcast(kept) if small_enough(kept, broadcast_nodes) else kept, "node").select("node", "set_id", "n", "tokens")


def _overlap(owner: np.ndarray, item: np.ndarray, m: int, width: int = 2048) -> np.ndarray:
    """How many items each two of ``m`` owners share; an owner has an item once."""
    items, item = np.unique(item, return_inverse=True)
    shared = np.bincount(item, minlength=len(items)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[item]
    owner, item = owner[keep], place[item[keep]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    common = np.zeros((m, m), np.float32 if shared.sum() < 1 << 24 else np.float64)  # whole numbers, so exact
    for lo in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(item, (lo, lo + width))
        x = np.zeros((m, width), np.float32)
        x[owner[a:z], item[a:z] - lo] = 1
        common += x @ x.T
    return common


def brute_force(sets: list[np.ndarray], block: np.ndarray, lower: list[list[int]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which members are similar, and which of these pairs count here.

    With two blocks only pairs across them are compared. ``lower`` has for each member the smaller
    nodes it is in: a pair that meets in one of them counts there.
    """
    m = len(sets)
    lengths = np.array([len(s) for s in sets])
    common = _overlap(np.repeat(np.arange(m), lengths), np.concatenate(sets), m)
    size = lengths.astype(np.float64)
    similar = np.zeros((m, m), bool)
    for lo in range(0, m, 256):
        c = common[lo : lo + 256].astype(np.float64)
        similar[lo : lo + 256] = c >= threshold * (size[lo : lo + 256, None] + size[None, :] - c) - 1e-9
    np.fill_diagonal(similar, False)
    if len(np.unique(block)) > 1:
        similar &= block[:, None] != block[None, :]
    if not any(lower):
        return similar, similar
    seen = _overlap(np.repeat(np.arange(m), [len(x) for x in lower]), np.array([x for xs in lower for x in xs], np.int64), m)
    return similar, similar & (seen == 0)


def _smallest_connected(similar: np.ndarray) -> np.ndarray:
    """For each member the smallest index of those it is connected with."""
    label = np.arange(len(similar))
    while True:
        near = np.where(similar, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with the same bucket, across batches, each set once."""
    key, rows = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != key and rows:
                yield [rows[x] for x in sorted(rows)]
                rows = {}
            key = row["bucket"]
            rows[row["set_id"]] = row
    if rows:
        yield [rows[x] for x in sorted(rows)]


def _verify(threshold: float):
    schema = pa.schema([("set_id", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _buckets(batches):
            sets = [_unpacked(r["shingles"]) for r in rows]
            lower = [[x for x in r["nodes"] if x < r["node"]] for r in rows]
            similar, counts = brute_force(sets, np.array([r["block"] for r in rows]), lower, threshold)
            links = counts @ np.array([r["copies"] for r in rows], np.int64)
            root = _smallest_connected(similar)
            linked = similar.any(1)
            out += [(rows[i]["set_id"], int(links[i]), rows[root[i]]["set_id"]) for i in np.flatnonzero(linked)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


_WIDTH = 6  # bytes of a shingle's hash that are sent


def _packed(h: np.ndarray) -> np.ndarray:
    """The low ``_WIDTH`` bytes of each hash."""
    return np.ascontiguousarray(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :_WIDTH])


def _unpacked(raw: bytes) -> np.ndarray:
    """Distinct hashes again."""
    wide = np.zeros((len(raw) // _WIDTH, 8), np.uint8)
    wide[:, :_WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, _WIDTH)
    return np.unique(wide.view("<u8").ravel())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of the edges (a, b): the smallest id that it is connected with."""
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = settle(lower.join(jump, "root", "left").select("id", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "labels")
        discard(labels)
        labels = new.select("id", "root")
        if new.where("root <> old").isEmpty():
            discard(both)
            return labels


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    recall: float = 0.9995,
    depth: int = 3,
    limit: int = 256,
    branches: int = 3,
    rounds: int = 3,
    block: int = 1024,
    block_tokens: int = 1 << 19,
    broadcast_sets: int = 250_000,
) -> DataFrame:
    """doc_id, class_id, n_links (documents at the threshold or above, copies included), class_size of every row."""
    bounded_batches(docs)
    runs = runs_needed(threshold, depth, recall, branches, rounds)
    all_rows = settle(signatures(docs, shingle, runs, depth), "signatures")
    some = all_rows.where("set_id is not null")
    members = settle(
        some.groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("nodes").alias("nodes")), "members"
    )
    nodes = settle(chosen_paths(members, some, limit, branches, rounds), "buckets")
    in_nodes = nodes.groupBy("set_id").agg(F.collect_list(F.struct("node", "n", "tokens")).alias("in_nodes"))
    wanted = settle(in_nodes.join(members.select("set_id", "copies"), "set_id"), "wanted")
    small = small_enough(wanted, broadcast_sets)
    texts = docs.select(F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    if small:  # else every text is hashed again
        keys = settle(some.join(F.broadcast(wanted.select("set_id")), "set_id", "left_semi").select("text_key").distinct(), "texts")
        texts = texts.join(F.broadcast(keys), "text_key", "left_semi") if small_enough(keys, 4 * broadcast_sets) else texts

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # by this task
        for batch in batches:
            for _, _, h, n, ids in _sets(batch.column(0), shingle):
                view, ends = memoryview(_packed(h)).cast("B"), _WIDTH * np.cumsum(n)
                found = {i: bytes(view[b - _WIDTH * k : b]) for i, b, k in zip(ids, ends, n, strict=True) if k and i not in sent}
                sent.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["set_id", "shingles"])

    sets = texts.select("text").mapInArrow(emit, "set_id binary, shingles binary")
    parts = F.least("at.n", F.greatest(F.ceil(F.col("at.n") / F.lit(block)), F.ceil(F.col("at.tokens") / F.lit(block_tokens)))).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    placed = (
        sets.join(F.broadcast(wanted) if small else wanted, "set_id")
        .withColumn("at", F.explode("in_nodes"))
        .withColumn("parts", parts)
        .withColumn("block", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "set_id",
            "copies",
            F.col("at.node").alias("node"),
            "block",
            F.transform("in_nodes", lambda x: x["node"]).alias("nodes"),
            F.xxhash64("at.node", F.least("block", "with"), F.greatest("block", "with")).alias("bucket"),
            "shingles",
        )
    )
    buckets = placed.repartition("bucket").sortWithinPartitions("bucket")
    found = settle(buckets.mapInArrow(_verify(threshold), "set_id binary, links long, other binary"), "links")
    discard(nodes, wanted)
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    classed = members.select("set_id", "copies", "least").join(links, "set_id", "left").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left")
    classed = settle(classed.withColumn("root", F.coalesce("root", "set_id")), "classes")
    discard(members, found, roots)
    grouped = classed.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    by_set = classed.join(grouped, "root").select("set_id", "class_id", "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = F.col("set_id").isNull()
    return (
        all_rows.select("doc_id", "set_id")
        .join(by_set, "set_id", "left")
        .select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        )
    )
