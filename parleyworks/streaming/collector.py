"""The collector as a running loop: statistics, penalties and alerts from a stream of calls.

Each micro-batch is a tick. Its calls are summed up by key and added to the lifetime totals that the tick before has left; the score of a
key is taken under the penalty of the tick before, and the new penalty waits for the next one. An alert opens at the tick in which a
metric passes its limit and is resolved, with that tick's number, when the metric is back within it.

Everything that a tick writes lies in folders of its number and replaces what they hold, and a tick reads only its own calls and the state of the
tick before. So a tick that runs again after a failure gives the same rows, once. A state has one row a key; the one before the last is deleted.

    scores/batch=N   key, total, rate, ms, penalty, score of the keys with calls in tick N
    alerts/batch=N   key, metric, severity, value, opened, resolved: alerts that opened (resolved is null) or were resolved in tick N
    state/batch=N    key and lifetime totals, the penalty for the next tick, and since when alerts are open
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.telemetry import routing_penalty, routing_score

_STATE = "total long, success long, sum_ms double, penalty double, rate_since long, ms_since long"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect(calls: DataFrame, tick: int, path: str, key: str, slow: float = 3000, scale: float = 10000, least_rate: float = 0.9, most_ms: float = 3000) -> None:
    """One tick over ``calls`` (key, ok, ms)."""
    spark, before = calls.sparkSession, f"{path}/state/batch={tick - 1}"
    kind = calls.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {_STATE}"
    if tick > 0 and not _exists(spark, before):
        raise ValueError(f"tick {tick} needs the state of the tick before it in {before}")
    state = (spark.read.schema(schema).parquet(before) if tick > 0 else spark.createDataFrame([], schema)).withColumnRenamed(key, "__of")
    new = calls.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("good"), F.sum("ms").alias("took"))
    zero = F.lit(0)
    joined = state.join(new.withColumn("__seen", F.lit(True)), F.col("__of").eqNullSafe(F.col(key)), "full")
    seen = F.coalesce("__seen", F.lit(False))
    now = joined.select(
        F.when(seen, F.col(key)).otherwise(F.col("__of")).alias(key),
        seen.alias("seen"),
        (F.coalesce("total", zero) + F.coalesce("n", zero)).alias("total"),
        (F.coalesce("success", zero) + F.coalesce("good", zero)).alias("success"),
        (F.coalesce("sum_ms", F.lit(0.0)) + F.coalesce("took", F.lit(0.0))).alias("sum_ms"),
        F.coalesce("penalty", F.lit(0.0)).alias("penalty"),
        "rate_since",
        "ms_since",
    )
    now = now.withColumns({"rate": F.col("success") / F.col("total"), "ms": F.col("sum_ms") / F.col("total")})
    low, late = F.col("rate") < least_rate, F.col("ms") > most_ms
    now = now.withColumns({"__rate": F.when(low, F.coalesce("rate_since", F.lit(tick))), "__ms": F.when(late, F.coalesce("ms_since", F.lit(tick)))}).persist()
    try:
        scored = now.where("seen").select(key, "total", "rate", "ms", "penalty", routing_score(F.col("rate"), F.col("ms"), F.col("penalty")).alias("score"))
        scored.write.mode("overwrite").parquet(f"{path}/scores/batch={tick}")
        metrics = F.array(
            *(
                F.struct(F.lit(name).alias("metric"), F.lit(severity).alias("severity"), F.col(value).alias("value"), F.col(old).alias("old"), F.col(held).alias("held"))
                for name, severity, value, old, held in (("success_rate", "error", "rate", "rate_since", "__rate"), ("avg_ms", "warning", "ms", "ms_since", "__ms"))
            )
        )
        changed = now.select(key, F.explode(metrics).alias("m")).where(F.col("m.old").isNull() != F.col("m.held").isNull())
        alerts = changed.select(key, "m.metric", "m.severity", "m.value", F.coalesce("m.old", "m.held").cast("long").alias("opened"), F.when(F.col("m.held").isNull(), F.lit(tick).cast("long")).alias("resolved"))
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={tick}")
        left = now.select(key, "total", "success", "sum_ms", routing_penalty(F.col("rate"), F.col("ms"), slow, scale).alias("penalty"), F.col("__rate").cast("long").alias("rate_since"), F.col("__ms").cast("long").alias("ms_since"))
        left.write.mode("overwrite").parquet(f"{path}/state/batch={tick}")
    finally:
        now.unpersist()
    _delete(spark, f"{path}/state/batch={tick - 2}")


def run(calls: DataFrame, path: str, key: str, every: str | None = "10 seconds", **limits: float) -> StreamingQuery:
    """Start the loop over a stream of ``calls``; without ``every`` it takes what is there and ends."""
    out = calls.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda df, tick: collect(df, tick, path, key, **limits))
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
