"""Classification reports, pass rates and run-over-run regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 over all labels of either column; 0 where a denominator is 0."""
    right = F.col(truth) == F.col(predicted)
    seen = df.select(
        F.explode(
            F.when(right, F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))).otherwise(
                F.array(
                    F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
                    F.struct(F.col(truth).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")),
                )
            )
        ).alias("x")
    ).select("x.*")
    out = seen.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    zero = F.lit(0.0)
    out = out.withColumns({"precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero), "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def overall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy and macro-F1, one row."""
    accuracy = df.agg(F.coalesce(F.avg((F.col(truth) == F.col(predicted)).cast("int")), F.lit(0.0)).alias("accuracy"))
    macro = per_class(df, truth, predicted).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    return accuracy.join(F.broadcast(macro))  # one row each


def metric_means(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean) of each metric that has a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")
    return df.select(pairs).select("x.*").where("v is not null").groupBy("metric").agg(F.avg("v").alias("mean"))


def regressions(runs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(run, metric, value, previous, delta) where a metric fell by more than ``tolerance`` of its previous value."""
    w = Window.partitionBy("metric").orderBy("run")
    out = runs.withColumn("previous", F.lag("value").over(w)).where("previous > 0")
    return out.withColumn("delta", (F.col("value") - F.col("previous")) / F.col("previous")).where(F.col("delta") < -tolerance)


def recommend(rules: Sequence[tuple[str, float, str]], none: str) -> Column:
    """The advice of every rule (metric column, floor, advice) whose metric is below its floor, in order; a missing metric passes."""
    advice = F.array_compact(F.array(*[F.when(F.coalesce(F.col(m), F.lit(1.0)) < floor, F.lit(text)) for m, floor, text in rules]))
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(none)))
