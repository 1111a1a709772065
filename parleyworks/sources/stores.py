"""Tables that grow: knowledge chunks, session logs, episodes and profiles, as Parquet folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import exploded_chunks
from ..operators.memory import latest_per_key
from .commits import Table


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows at ``path``; none where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


CHUNK = "chunk_id string, title string, chunk_index int, total_chunks int, text string"


def chunk_rows(docs: DataFrame, size: int = 500, **options) -> DataFrame:
    """Chunks of documents (title, content); the id is a hash of title, place and beginning."""
    df = exploded_chunks(docs.select("title", "content"), "content", size, **options, names=("total_chunks", "chunk_index", "text"))
    return df.select(F.md5(F.concat_ws("_", "title", F.col("chunk_index").cast("string"), F.substring("text", 1, 50))).alias("chunk_id"), "title", "chunk_index", "total_chunks", "text")


def chunk_table(spark: SparkSession, path: str) -> Table:
    """The chunk store at ``path``, which several writers may add to."""
    return Table(spark, path, CHUNK, ["chunk_id"])


def add_chunks(docs: DataFrame, path: str, **options) -> int:
    """Store the chunks of documents; an id that is stored stays as it is. Returns how many were submitted."""
    rows = chunk_rows(docs, **options)
    n = rows.count()
    chunk_table(docs.sparkSession, path).add(rows)
    return n


def seed_when_empty(seed: DataFrame, path: str, **options) -> int:
    """Store the chunks of ``seed`` where nothing is stored yet; returns how many were submitted."""
    if not chunk_table(seed.sparkSession, path).read().isEmpty():
        return 0
    return add_chunks(seed, path, **options)


def add_templates(corrected: DataFrame, path: str) -> None:
    """Store corrected messages (label, text) as templates of their labels; a stored one stays as it is."""
    known = stored(corrected.sparkSession, path, "label string, text string")
    new = corrected.select("label", "text").distinct().join(known, ["label", "text"], "left_anti")
    new.write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add messages, summaries or episodes to their log."""
    rows.write.mode("append").parquet(path)


def live_log(log: DataFrame, keys: Sequence[str], at: str, now: int, ttl: int = 86_400_000_000) -> DataFrame:
    """Rows of the sessions whose last row is less than ``ttl`` microseconds before ``now``."""
    alive = log.groupBy(*keys).agg(F.max(at).alias("__last")).where(F.lit(now) - F.col("__last") < ttl).drop("__last")
    return log.join(alive, list(keys), "left_semi")


def profile_table(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> Table:
    """The profiles at ``path``: ``upsert(rows, order)`` keeps the newest of each key and touches the buckets of ``rows`` alone."""
    return Table(spark, path, schema, keys)


def upsert_profiles(new: DataFrame, old: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the newest of both tables."""
    return latest_per_key(old.unionByName(new), keys, order)
