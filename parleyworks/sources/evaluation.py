"""Labelled cases from JSON files, and reports of evaluation runs that are stored and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluate import regressions
from .stores import stored

INTENT_CASES = (
    "id string, query string, expected_intent string, expected_group string, "
    "entities struct<order_id:array<string>,error_code:array<string>,date:array<string>,amount:array<string>>, type string, history array<struct<role:string,content:string>>"
)
ROUTING_CASES = "id string, query string, expected_primary_domain string, expected_supporting_domains array<string>, signals array<string>, purpose string"
RUN = "run string, total long, passed long, pass_rate double, metric string, value double"


def read_cases(spark: SparkSession, path: str, schema: str = INTENT_CASES) -> DataFrame:
    """The cases of a JSON array, one row each; absent fields are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_label_groups(spark: SparkSession, path: str) -> DataFrame:
    """(label, label_group, is_specific) from a file of labels; a label without a group is its own."""
    kind = "intent_labels array<string>, specific_intents array<string>, intent_groups map<string,string>"
    f = spark.read.schema(kind).json(path, multiLine=True)
    rows = f.select(F.explode("intent_labels").alias("label"), "specific_intents", "intent_groups")
    return rows.select("label", F.coalesce(F.try_element_at("intent_groups", F.col("label")), "label").alias("label_group"), F.array_contains("specific_intents", F.col("label")).alias("is_specific"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A stored report as rows (run, total, passed, pass_rate, metric, value)."""
    kind = "timestamp string, total long, passed long, pass_rate double, avg_scores map<string,double>"
    f = spark.read.schema(kind).json(path, multiLine=True)
    return f.select(F.col("timestamp").alias("run"), "total", "passed", "pass_rate", F.explode("avg_scores").alias("metric", "value"))


def report(results: DataFrame, run: str) -> DataFrame:
    """Rows (run, total, passed, pass_rate, metric, value) from results (test_id, passed, scores: a map of metrics); metrics without a value are left out."""
    total = results.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("passed"))
    total = total.withColumn("pass_rate", F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)))
    means = results.select(F.explode("scores").alias("metric", "v")).where("v is not null").groupBy("metric").agg(F.round(F.avg("v"), 4).alias("value"))
    return means.join(F.broadcast(total)).select(F.lit(run).alias("run"), "total", "passed", "pass_rate", "metric", "value")  # one row of totals


def store_run(rows: DataFrame, path: str) -> DataFrame:
    """Add a run to the stored ones; gives the metrics (run, metric, value, previous, delta) that fell against the run before it."""
    spark = rows.sparkSession
    rows.write.mode("append").parquet(path)
    runs = stored(spark, path, RUN)
    last = runs.select("run").distinct().withColumn("n", F.row_number().over(Window.orderBy(F.desc("run")))).where("n <= 2")  # runs are few
    return regressions(runs.join(F.broadcast(last.drop("n")), "run").select("run", "metric", "value"))
