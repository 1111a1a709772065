"""Call statistics, alerts and per-key state over a call log (key, at, ok, ms)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_stats(calls: DataFrame, key: str, tool_recipe: bool = False) -> DataFrame:
    """Total, success rate (1 where empty), mean ms (0 where empty) and the routing score.

    Failures count in the mean; with ``tool_recipe`` they count as calls and add no time.
    """
    ms = F.when(F.col("ok"), F.col("ms")).otherwise(0.0) if tool_recipe else F.col("ms")
    out = calls.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("ok").cast("int")).alias("success"), F.sum(ms).alias("sum_ms"))
    out = out.withColumns({"success_rate": F.coalesce(F.try_divide("success", "total"), F.lit(1.0)), "avg_ms": F.coalesce(F.try_divide("sum_ms", "total"), F.lit(0.0))})
    return out.withColumn("score", routing_score(F.col("success_rate"), F.col("avg_ms"))).drop("sum_ms")


def routing_score(rate: Column, ms: Column, penalty: Column | float = 0.0) -> Column:
    p = penalty if isinstance(penalty, Column) else F.lit(penalty)
    return (0.7 * rate + 0.3 / (1 + ms / 1000)) * F.greatest(F.lit(0.0), 1 - p)


def routing_penalty(rate: Column, ms: Column, slow: float = 3000, scale: float = 10000) -> Column:
    a = F.when(rate < 0.9, F.least(F.lit(0.5), (0.9 - rate) * 2)).otherwise(0.0)
    b = F.when(ms > slow, F.least(F.lit(0.4), (ms - slow) / scale)).otherwise(0.0)
    return F.least(F.lit(0.9), a + b)


def cut_points(df: DataFrame, key: str, at: str, rows: int) -> DataFrame | None:
    """(__of, __cuts): for each key of over ``rows`` rows the ascending values of ``at`` that cut it into parts of about ``rows`` rows; None where no key is that large.

    The keys are at most the rows of ``df`` / ``rows``; cuts are approximate quantiles. Counting takes one aggregation with partial
    counts; only where it finds a large key are there parts.
    """
    large = df.groupBy(F.col(key).alias("__of")).agg(F.count(at).alias("__n")).where(F.col("__n") > rows)
    most = large.agg(F.max("__n")).first()[0]
    if most is None:
        return None
    parts = math.ceil(most / rows)
    own = df.select(F.col(key).alias("__key"), F.col(at).alias("__at")).join(F.broadcast(large), F.col("__key").eqNullSafe(F.col("__of")))
    quantiles = F.percentile_approx("__at", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))
    return own.groupBy("__of").agg(F.array_distinct(F.array_sort(quantiles)).alias("__cuts"))


def _blocked(df: DataFrame, key: str, at: str, rows: int) -> tuple[DataFrame, bool]:
    """``df`` with ``__block``, the number of the part of its key that a row is in, and whether any key has parts. Rows without a time come first."""
    cuts = cut_points(df, key, at, rows)
    if cuts is None:
        return df.withColumn("__block", F.lit(0)), False
    joined = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("__of")), "left")
    most = F.ceil(F.log2(F.size("__cuts"))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), most), lambda i: F.pow(F.lit(2), most - i).cast("int"))
    # halving: how many cuts are not after the row
    up_to = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size("__cuts")) & (F.get("__cuts", n + s - 1) <= F.col(at)), n + s).otherwise(n))
    return joined.withColumn("__block", F.when(F.col("__cuts").isNull(), 0).when(F.col(at).isNull(), -1).otherwise(up_to)).drop("__of", "__cuts"), True


def _with_blocks(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``blocks`` (key, __block, ...) has on their block; null keys are equal to themselves."""
    b = blocks.withColumnsRenamed({key: "__of", "__block": "__at"})
    return rows.join(b, F.col(key).eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__at"))).drop("__of", "__at", "__block")


def running_totals(df: DataFrame, key: str, order: Sequence[str], totals: Mapping[str, Column], rows: int = 1_000_000) -> DataFrame:
    """``df`` with running sums along each key's rows in order; ``totals`` names them.

    ``order[0]`` is a number. A prefix scan: a key of over ``rows`` rows is cut by order into parts of about as many, each part is summed
    and scanned by itself, and a part's scan starts with the sums of the parts before. So blocks follow the data, and a hot key is
    many tasks. Null values add nothing and null times come first.
    """
    blocked, cut = _blocked(df, key, order[0], rows)
    inside = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumns({n: F.sum(c).over(inside) for n, c in totals.items()})
    zero = F.lit(0)
    if not cut:
        return out.withColumns({n: F.coalesce(F.col(n), zero) for n in totals}).drop("__block")
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(key, "__block").agg(*[F.sum(c).alias(f"__{n}") for n, c in totals.items()])
    begin = sums.select(key, "__block", *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in totals])
    out = _with_blocks(out, begin, key)
    return out.withColumns({n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"__{n}"), zero) for n in totals}).drop(*[f"__{n}" for n in totals])


def rolling_zscore(df: DataFrame, key: str, order: Sequence[str], value: str, window: int = 60, least: int = 30, limit: float = 2.5, rows: int = 1_000_000) -> DataFrame:
    """Rows whose value is over ``limit`` sample deviations from the mean of the last ``window`` rows, itself included.

    A key of over ``rows`` rows is cut by order into parts of about as many, at least ``window``; its rows are numbered by a prefix scan and
    the last ones of a chunk of numbers also stand before the next, so windows are whole and a hot key is many tasks.
    """
    rows = max(rows, window)

    def marked(dealt: DataFrame, by: list[str], along: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*along).rowsBetween(1 - window, 0)
        z = F.abs(F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
        out = dealt.withColumns({"z": z, "n": F.count(F.lit(1)).over(w)}).where((F.col("n") >= least) & (F.col("z") > limit))
        return out.withColumn("severity", F.when(F.col("z") > 1.5 * limit, "high").otherwise("medium")).drop("n")

    if df.groupBy(key).count().where(F.col("count") > rows).isEmpty():
        return marked(df, [key], list(order))
    place = F.col("__row") - 1
    numbered = running_totals(df, key, order, {"__row": F.lit(1)}, rows).withColumn("__chunk", F.floor(place / rows))
    lent = place % rows >= rows - (window - 1)
    dealt = numbered.withColumn("__to", F.explode(F.when(lent, F.array(F.col("__chunk"), F.col("__chunk") + 1)).otherwise(F.array("__chunk"))))
    return marked(dealt, [key, "__to"], ["__row"]).where(F.col("__to") == F.col("__chunk")).drop("__row", "__chunk", "__to")


def failure_streaks(calls: DataFrame, key: str, order: Sequence[str], rows: int = 1_000_000) -> DataFrame:
    """``streak``: failures since the last success, at each call.

    A part of a key of over ``rows`` rows runs by itself; a streak that no success in the part has ended goes on from the parts before it.
    """
    blocked, cut = _blocked(calls, key, order[0], rows)
    w = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    good, bad = F.coalesce(F.col("ok").cast("int"), F.lit(0)), F.coalesce((~F.col("ok")).cast("int"), F.lit(0))
    out = blocked.withColumns({"__good": F.sum(good).over(w), "__bad": F.sum(bad).over(w)})
    since = F.col("__bad") - F.coalesce(F.max(F.when(F.col("ok"), F.col("__bad"))).over(w), F.lit(0))
    out = out.withColumn("streak", since)
    if not cut:
        return out.drop("__good", "__bad", "__block")
    last = F.struct(*order)
    ends = out.groupBy(key, "__block").agg(F.max("__good").alias("__any"), F.max_by("streak", last).alias("__tail"))
    by_key = Window.partitionBy(key).orderBy("__block")
    ends = ends.withColumn("__island", F.sum((F.col("__any") > 0).cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("__after", F.sum("__tail").over(Window.partitionBy(key, "__island").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)))
    begin = ends.select(key, "__block", F.coalesce(F.lag("__after").over(by_key), F.lit(0)).alias("__open"))
    met = _with_blocks(out, begin, key)
    return met.withColumn("streak", F.col("streak") + F.when(F.col("__good") == 0, F.col("__open")).otherwise(0)).drop("__good", "__bad", "__open")


def resolutions(calls: DataFrame, key: str, order: Sequence[str], rows: int = 1_000_000) -> DataFrame:
    """``resolved_at``: the time (``order[0]``) of the key's next success after each call; null while there is none.

    A part of a key of over ``rows`` rows looks into itself; where it has no later success, the first one of the parts after it counts.
    """
    at = order[0]
    blocked, cut = _blocked(calls, key, at, rows)
    good = F.when(F.col("ok"), F.col(at))
    following = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    out = blocked.withColumn("resolved_at", F.min(good).over(following))
    if not cut:
        return out.drop("__block")
    after = Window.partitionBy(key).orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    later = blocked.groupBy(key, "__block").agg(F.min(good).alias("__first")).select(key, "__block", F.min("__first").over(after).alias("__later"))
    return _with_blocks(out, later, key).withColumn("resolved_at", F.coalesce("resolved_at", "__later")).drop("__later")


def sessions(df: DataFrame, key: str, at: str, tie: str, gap: int, rows: int = 1_000_000) -> DataFrame:
    """``session`` numbers from 0: a new one where ``gap`` or more has passed.

    Gaps inside a part of a key of over ``rows`` rows are counted there; those between parts from the parts' first and last times.
    """
    blocked, cut = _blocked(df, key, at, rows)
    w = Window.partitionBy(key, "__block").orderBy(at, tie)
    marked = blocked.withColumn("__new", F.coalesce((F.col(at) - F.lag(at).over(w) >= gap).cast("int"), F.lit(0)))
    inside = marked.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not cut:
        return inside.drop("__new", "__block")
    by_key = Window.partitionBy(key).orderBy("__block")
    ends = marked.groupBy(key, "__block").agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.sum("__new").alias("__in"))
    start = F.coalesce((F.col("__first") - F.lag("__last").over(by_key) >= gap).cast("int"), F.lit(0))
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    begin = ends.withColumn("__start", start).select(key, "__block", (F.sum(F.col("__start") + F.col("__in")).over(so_far) - F.col("__in")).alias("__base"))
    return _with_blocks(inside, begin, key).withColumn("session", F.col("session") + F.col("__base")).drop("__new", "__base")


def fold_sorted(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, str]], columns: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out`` from a state machine run along each key's rows in order.

    Rows are dealt by key and sorted by Spark (which spills); a task then holds one key's state and
    one batch, however many rows a key has. Keys are compared as they are: null is a key of its own,
    and large numbers stay exact.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, current, state = False, None, None
        for batch in batches:
            said = []
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, *columns)), strict=True):
                if not begun or row[0] != current:
                    begun, current, state = True, row[0], start()
                state, word = step(state, row[1:])
                said.append(word)
            yield batch.append_column(out, pa.array(said, pa.string()))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{schema}, {out} string")


def breaker_step(threshold: int, recovery: int):
    """Closed, open after ``threshold`` failures since the last success, half-open ``recovery`` later."""

    def step(state, row):
        fails, opened, half = state
        at, ok = row
        if opened is not None and not half:
            if at - opened < recovery:
                return (fails, opened, False), "rejected"
            half = True
        if ok:
            return (0, None, False), "closed"
        fails += 1
        if half or fails >= threshold:
            return (fails, at, False), "opened"
        return (fails, None, False), "failed"

    return step


def circuit_breaker(calls: DataFrame, key: str, at: str, tie: str, ok: str, threshold: int = 5, recovery: int = 60_000_000) -> DataFrame:
    """``outcome``: closed, failed, opened or rejected (rejected calls change nothing)."""
    return fold_sorted(calls, key, [at, tie], lambda: (0, None, False), breaker_step(threshold, recovery), [at, ok], "outcome")


def ttl_cache(calls: DataFrame, key: str, at: str, tie: str, ok: str, ttl: int = 300_000_000) -> DataFrame:
    """``outcome``: hit before the entry expires, else stored (a success) or missed."""

    def step(expiry, row):
        now, good = row
        if expiry and now < expiry:
            return expiry, "hit"
        return (now + ttl, "stored") if good else (expiry, "missed")

    return fold_sorted(calls, key, [at, tie], lambda: 0, step, [at, ok], "outcome")


def gauge(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """(key, value, samples): the last value of each key, by partial aggregation."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("samples"))


def best_instance(stats: DataFrame, group: str, instance: str, score: str) -> DataFrame:
    """(group, instance, score): the instance with the best score; the smallest of equal ones."""
    best = F.struct((-F.col(score)).alias("neg"), F.col(instance).alias("id"))
    return stats.groupBy(group).agg(F.min(best).alias("b")).select(group, F.col("b.id").alias(instance), (-F.col("b.neg")).alias(score))


def penalised(stats: DataFrame, penalties: DataFrame, key: str, most: float = 0.9) -> DataFrame:
    """``stats`` with ``penalty``, looked up by key (one row a key; 0 without one, clamped to 0 and ``most``), and the ``score`` under it."""
    p = penalties.select(F.col(key).alias("__of"), F.col("penalty").alias("__found"))
    out = stats.join(p, F.col(key) == F.col("__of"), "left").withColumn("penalty", F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce("__found", F.lit(0.0)))))
    return out.withColumn("score", routing_score(F.col("success_rate"), F.col("avg_ms"), F.col("penalty"))).drop("__of", "__found")


def exposition(metric: str, labels: Mapping[str, Column], value: Column) -> Column:
    """One line of metrics as text, ``metric{label="value",...} value``; backslashes, quotes and line ends of label values are escaped."""

    def quoted(x: Column) -> Column:
        x = F.coalesce(x.cast("string"), F.lit(""))
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            x = F.replace(x, F.lit(plain), F.lit(escaped))
        return x

    parts = [F.concat(F.lit(f'{name}="'), quoted(x), F.lit('"')) for name, x in labels.items()]
    return F.concat(F.lit(metric + "{"), F.concat_ws(",", *parts), F.lit("} "), value.cast("string"))


def suggestions(tools: DataFrame, agents: DataFrame, streak: int = 3, rate: float = 0.85, calls: int = 10, most: int = 5) -> DataFrame:
    """The ``most`` urgent suggestions (title, priority): tools (key, streak) that fail on, agents (key, total, success_rate) that fail often.

    Equal titles count once. Of equal priority the smaller title comes first.
    """
    failing = tools.where(F.col("streak") >= streak).select(F.format_string("tool %s failed %d times in a row", F.col("key").cast("string"), F.col("streak")).alias("title"), F.lit(9).alias("priority"))
    weak = agents.where((F.col("success_rate") < rate) & (F.col("total") > calls)).select(F.format_string("agent %s has a low success rate", F.col("key").cast("string")).alias("title"), F.lit(8).alias("priority"))
    every = failing.unionByName(weak).groupBy("title").agg(F.max("priority").alias("priority"))
    return every.orderBy(F.desc("priority"), "title").limit(most)


def with_fallback(result: Column, ok: Column, fallback: Column, error: Column) -> Column:
    """(result, success, error): a failed call gives its fallback as a success with the error's text; without one it fails."""
    return F.when(ok, F.struct(result.alias("result"), F.lit(True).alias("success"), F.lit("").alias("error"))).otherwise(
        F.struct(fallback.alias("result"), fallback.isNotNull().alias("success"), error.alias("error"))
    )


def feedback(ticks: DataFrame, key: str, tick: str, slow: float = 3000, scale: float = 10000) -> DataFrame:
    """``penalty`` and ``score`` at each tick: lifetime totals, penalised by what the tick before has found.

    ``ticks`` has total, success and sum_ms of each key and tick, so a key has as many rows as there are ticks.
    """
    w = Window.partitionBy(key).orderBy(tick)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("total").over(so_far)
    out = ticks.withColumns({"rate": F.sum("success").over(so_far) / total, "ms": F.sum("sum_ms").over(so_far) / total})
    out = out.withColumn("next", routing_penalty(F.col("rate"), F.col("ms"), slow, scale))
    out = out.withColumn("penalty", F.coalesce(F.lag("next").over(w), F.lit(0.0)))
    return out.withColumn("score", routing_score(F.col("rate"), F.col("ms"), F.col("penalty"))).drop("next")
