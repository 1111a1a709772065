"""Conversation memory: last-N reads, compaction, profiles, budgets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    """The newest ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def compact(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: int = 15, keep: int = 5) -> DataFrame:
    """``batch``: the number of the compaction that takes the row, null where it is still live.

    Closed form of appending one row after another and compacting all but ``keep`` at ``at`` rows.
    """
    w = Window.partitionBy(*keys)
    out = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    times = F.greatest(F.floor((F.col("__n") - keep) / F.lit(at - keep)), F.lit(0))
    batch = F.floor(F.col("__i") / F.lit(at - keep))
    return out.withColumn("batch", F.when(batch < times, batch)).drop("__i", "__n")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return last_n(df, keys, order, 1)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The oldest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def ordered_concat(order: Column, text: Column, separator: str) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def _same_as_before(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each value is that of the row before, ``last`` before the first; nulls are equal."""
    before = pa.concat_arrays([pa.array([None if last is None else last.as_py()], column.type), column.slice(0, len(column) - 1)])
    equal = pc.fill_null(pc.equal(column, before), False).to_numpy(zero_copy_only=False)
    return equal | (column.is_null().to_numpy(zero_copy_only=False) & before.is_null().to_numpy(zero_copy_only=False))


def first_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, budget: int) -> DataFrame:
    """``df`` without rows that follow, in their own task, ``budget`` characters or more of their key.

    Each task sorts its rows and passes on the first ones of a key, so a key of any size leaves a task with a budget and one row
    more; what a task drops no order of all rows could keep. The first rows of several tasks merge in the same way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, spent = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            same = np.logical_and.reduce([_same_as_before(c, None if last is None else last[i]) for i, c in enumerate(columns)])
            same[0] &= last is not None
            size = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy().astype(np.int64)
            total = np.cumsum(size)
            begins = np.maximum.accumulate(np.where(~same, np.arange(len(same)), -1))
            base = np.where(begins >= 0, (total - size)[np.maximum(begins, 0)], -spent)
            earlier = total - size - base
            last, spent = [c[-1] for c in columns], int(earlier[-1] + size[-1])
            yield batch.filter(pa.array(earlier < budget))

    return df.sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, budget: int = 5000, each: int = 3200, mark: str = "\n...") -> DataFrame:
    """Texts in order until ``budget`` characters; each is capped first, the one that overflows is cut and marked. Null texts take no room.

    Tasks drop before the shuffle what cannot be within the budget, so a hot key moves at most a budget from each of them.
    """
    capped = F.when(F.length(text) <= each, F.col(text)).otherwise(F.concat(F.rtrim(F.substring(text, 1, each)), F.lit(mark)))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = first_within(df.withColumn(text, capped), keys, order, text, budget)
    out = out.withColumn("__left", budget - F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).where("__left > 0")
    room = F.greatest(F.col("__left") - len(mark), F.lit(0)).cast("int")
    cut = F.when(F.length(text) <= F.col("__left"), F.col(text)).otherwise(F.concat(F.rtrim(F.col(text).substr(F.lit(1), room)), F.lit(mark)))
    return out.withColumn(text, cut).drop("__left")


def assemble(recent: DataFrame, history: DataFrame, profile: DataFrame, summary: DataFrame, conv: str = "conv_id", user: str = "user_id") -> DataFrame:
    """One row of memory for each session of ``recent`` (conv, user, recent): its near episodes (conv, history), its user's profile (user, profile) and its summary (conv, summary); blank where there is none."""
    out = recent.join(history, conv, "left").join(summary, conv, "left").join(profile, user, "left")
    return out.select(conv, user, "recent", *[F.coalesce(c, F.lit("")).alias(c) for c in ("history", "profile", "summary")])
