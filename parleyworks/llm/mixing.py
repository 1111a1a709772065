"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w (of all weights) and c of the corpus's C characters gets the mean repetition
rate w * C * epochs / c. Each document inverts the Poisson distribution with that mean at a uniform
number in [0, 1) that a hash of the seed and its id gives: its count is the number of k with
P(X <= k) <= u. It is exploded by the count, and the copies are shuffled globally: dealt out and
sorted by a hash of seed, id and copy number.

The distribution is worked out once for each source, as a running sum over the terms within 12
standard deviations and 30 of the mean (the rest weighs less than a double can tell), so its size
and work grow with the root of the mean, and a document finds its number by binary search. The table
of sources is broadcast up to ``broadcast_terms`` terms, else joined by key (AQE splits a hot
source).

Defined results: null text has no characters; a source without characters has rate 0 and gives no
rows; null sources are one source; a source that the weights leave out has weight 0; rows that
repeat an id get the same count and the same keys; an empty table gives an empty result. Other
columns pass through; the names of the three added columns are a parameter, and replace columns of
these names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settle

DIGITS = 13  # hexadecimal digits of a hash: 52 bits, whole in a double


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """(source, least, cdf) from (source, rate): P(X <= k) for k = least, least + 1, ... as an array.

    A term is the one before times mean / k. Their running product starts at 1 and is divided by its sum.
    """
    reach = 12 * F.sqrt("rate") + 30
    least = F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).cast("long")
    terms = rates.withColumns({"least": least, "k": F.explode(F.sequence(least, F.when(F.col("rate") > 0, F.ceil(F.col("rate") + reach)).otherwise(0).cast("long")))})
    running = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_p = F.when(F.col("k") > F.col("least"), F.log(F.col("rate") / F.col("k"))).otherwise(0.0)
    weights = terms.withColumn("p", F.exp(F.sum(log_p).over(running))).withColumn("c", F.sum("p").over(running))
    by_source = weights.groupBy("source", "least").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("every"))
    return by_source.select("source", "least", F.transform("every", lambda x: x["c"] / F.element_at("every", -1)["c"]).alias("cdf"))


def places_up_to(ordered: Column, x: Column) -> Column:
    """How many entries of an ascending array are at most ``x``, by binary search."""
    step = lambda at, _: F.struct(
        F.when(F.get(ordered, ((at["lo"] + at["hi"]) / 2).cast("int")) <= x, ((at["lo"] + at["hi"]) / 2).cast("int") + 1).otherwise(at["lo"]).alias("lo"),
        F.when(F.get(ordered, ((at["lo"] + at["hi"]) / 2).cast("int")) <= x, at["hi"]).otherwise(((at["lo"] + at["hi"]) / 2).cast("int")).alias("hi"),
    )
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + 1)).cast("int") + 1)
    # a range of one place stays: its middle is past the end, where null is not at most x
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), step, lambda at: at["lo"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """(source, rate): the mean repetitions. Without weights, a source weighs its characters to the power ``alpha``."""
    per = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).withColumn("chars", F.coalesce("chars", F.lit(0)))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    per = per.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    all_of = per.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_chars") * F.lit(float(epochs)) / F.col("chars")
    joined = per.join(F.broadcast(all_of))  # one row
    return joined.select("source", F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    added: tuple[str, str, str] = ("copy_no", "copies", "shuffle_key"),
    broadcast_terms: int = 2_000_000,
) -> DataFrame:
    """``docs`` replicated to the target weights, in random order, with the copy's number (from 1), the copies and the shuffle key."""
    copy_no, copies, key = added
    name = free_name(docs, "__mx")
    source, least, cdf, u = f"{name}source", f"{name}least", f"{name}cdf", f"{name}u"
    table = settle(poisson_cdf(rates(docs, weights, alpha, epochs)).toDF(source, least, cdf), "rates")
    small = (table.agg(F.sum(F.size(cdf) + 8)).first()[0] or 0) <= broadcast_terms
    joined = docs.drop(*added).join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col(source)), "left")
    joined = joined.withColumn(u, uniform(seed, F.col("doc_id"))).withColumn(copies, (F.col(least) + places_up_to(F.col(cdf), F.col(u))).cast("int"))
    copied = joined.drop(source, least, cdf, u).where(F.col(copies) > 0).withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(copies))))
    text = F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy_no).cast("string"))
    return copied.withColumn(key, F.md5(text)).repartition(key).sortWithinPartitions(key)
