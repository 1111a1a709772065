"""What the operators of this subpackage share: tables, folds, samples and written steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new local one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage, survives lost executors, is computed once however often it is read, and
    lets Spark plan with the real size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        spark, folders = df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether a settled table has at most ``limit`` rows; the check that stands before every broadcast."""
    return df.limit(limit + 1).count() <= limit


def semi_join(left: DataFrame, keys: DataFrame, on: list[str], limit: int = 1_000_000) -> DataFrame:
    """Rows of ``left`` whose key is among ``keys`` (settled): broadcast up to ``limit`` keys, shuffled beyond."""
    return left.join(F.broadcast(keys) if small_enough(keys, limit) else keys, on, "left_semi")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def bounded_sample(df: DataFrame, group: str, key: str, limit: int, seed: int = 0) -> DataFrame:
    """About ``limit`` rows of each group, all rows where a group has fewer.

    The share kept comes from a count of each group and the choice from a hash of ``key`` and of the
    row's place in the table, so no row is moved to choose it and rows that repeat a key are chosen each. At
    most ``limit`` plus its sampling error (a few of its square roots) stay.
    """
    value, rate, place = (free_name(df, x) for x in ("sample_value", "sample_rate", "sample_place"))
    rates = settle(df.groupBy(F.col(group).alias(value)).agg((F.lit(float(limit)) / F.count(F.lit(1))).alias(rate)), "sample-rates")
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(place)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = df.withColumn(place, F.monotonically_increasing_id()).join(F.broadcast(rates) if small_enough(rates, 1_000_000) else rates, F.col(group).eqNullSafe(F.col(value)))
    return rated.where(spread < F.col(rate)).drop(value, rate, place)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` starts with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def bounded_batches(df: DataFrame, size: int = 8 << 20) -> None:
    """Let batches that go to Python hold at most about ``size`` bytes, unless the session asks for less.

    Such a batch exists in the JVM's memory beside the heap and in the worker, for every task.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)b?$", conf.get(key))
    if now is None or not 0 < int(now[1]) <= size:
        conf.set(key, str(size))
