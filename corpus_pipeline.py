"""A corpus pipeline of five operators; each stage reads what the one before it has written.

The stages take (spark, docs, sf_dir). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleyworks.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from parleyworks.llm.common import free_name, settle, small_enough, table

#: No SQL: the classifier, the probabilistic join and the tokenizer have none.
ORACLE_SQL = None

#: The share of a source's documents beyond which a line is boilerplate. A source is no web host: it mixes
#: many sites, so what repeats stands in about a tenth of it, and other lines in less than a twentieth.
SOURCE_RATIO = 0.05

#: Documents of a source that a line stands in, at least: two or three copies of a text make none of its lines boilerplate.
SOURCE_DOCUMENTS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on these documents and the labels, doesn't call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.score_toxicity(docs, model, score).where(F.col(score) < 0.5).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a large share of their source's documents has; none goes, and none is emptied."""
    left = line_dedup.line_dedup(docs, "source", "text", ratio=SOURCE_RATIO, min_pages=SOURCE_DOCUMENTS, keep_whole=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that of the smallest id, null ids last, the first such row.

    Rows are told apart by a written key, so null and repeated ids are rows like any other.
    """
    row = free_name(docs, "row")
    keyed = settle(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    joined = jaccard_join.jaccard_join(keyed.select(order.alias("doc_id"), "text"))
    gone = settle(joined.where(F.col("doc_id.row") != F.col("class_id.row")).select(F.col("doc_id.row").alias(row)), "gone")
    return keyed.join(F.broadcast(gone) if small_enough(gone, 1_000_000) else gone, row, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order."""
    added = tuple(free_name(docs, x) for x in ("copy_no", "copies", "shuffle_key"))
    return mixing.mix(docs, added=added).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in pieces of power-of-two length, grouped by length."""
    return packing.buckets(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
