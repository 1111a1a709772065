"""Jobs over labelled corpora: from files of cases to a stored report that is compared with the run before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENTITIES, entities
from ..operators import evaluate
from ..sources import evaluation

#: The share of a test's scores that passes.
BAR = 0.75


def intent_results(cases: DataFrame, groups: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each case with ``label``, whether label and group are right, and the share of its expected entities that are found (null where it expects none).

    ``predict`` adds ``label`` to a table with ``query``. The label's group is that of ``groups`` (label, label_group), its own where it has none.
    """
    groups = groups.select("label", "label_group").dropDuplicates(["label"])
    labelled = predict(cases).join(groups, "label", "left").withColumn("label_group", F.coalesce("label_group", "label"))
    seen = labelled.withColumns({f"__{k}": c for k, c in entities(F.col("query")).items()})
    wanted = lambda k: F.array_distinct(F.coalesce(F.col(f"entities.{k}"), F.array().cast("array<string>")))
    total = sum((F.size(wanted(k)) for k in ENTITIES), F.lit(0))
    found = sum((F.size(F.array_intersect(wanted(k), F.col(f"__{k}"))) for k in ENTITIES), F.lit(0))
    return seen.select(*cases.columns, "label", (F.col("label") == F.col("expected_intent")).alias("right"), (F.col("label_group") == F.col("expected_group")).alias("group_right"), F.try_divide(found, total).alias("entity_recall"))


def intent_scores(results: DataFrame, bar: float = BAR) -> DataFrame:
    """(test_id, passed, scores): one row for the corpus, and one for each type of case."""
    overall = evaluate.overall(results, "expected_intent", "label")
    parts = results.agg(F.coalesce(F.avg(F.col("group_right").cast("int")), F.lit(0.0)).alias("group_accuracy"), F.avg("entity_recall").alias("entity_recall"))
    whole = overall.join(F.broadcast(parts)).select(F.lit("intent_recognition").alias("test_id"), _scores("accuracy", "macro_f1", "group_accuracy", "entity_recall"), F.col("accuracy").alias("first"))
    kinds = results.groupBy("type").agg(F.avg(F.col("right").cast("int")).alias("type_accuracy"))
    by_type = kinds.select(F.concat(F.lit("intent_"), F.coalesce("type", F.lit("other"))).alias("test_id"), _scores("type_accuracy"), F.col("type_accuracy").alias("first"))
    return whole.unionByName(by_type).select("test_id", (F.col("first") >= bar).alias("passed"), "scores")


def _scores(*names: str) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("double") for n in names))).alias("scores")


def routing_results(cases: DataFrame, route: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each case with ``primary`` and ``supporting`` (an array) that ``route`` adds, whether the domain is right, and the share of the expected supporting domains that are there."""
    expected = F.array_distinct(F.coalesce("expected_supporting_domains", F.array().cast("array<string>")))
    routed = route(cases)
    shared = F.size(F.array_intersect(expected, F.coalesce("supporting", F.array().cast("array<string>"))))
    return routed.withColumns({"right": F.col("primary") == F.col("expected_primary_domain"), "supporting_recall": F.try_divide(shared, F.size(expected))})


def routing_scores(results: DataFrame, bar: float = BAR) -> DataFrame:
    """(test_id, passed, scores) of the corpus, one row."""
    parts = results.agg(F.coalesce(F.avg(F.col("right").cast("int")), F.lit(0.0)).alias("routing_accuracy"), F.avg("supporting_recall").alias("supporting_recall"))
    return parts.select(F.lit("routing").alias("test_id"), (F.col("routing_accuracy") >= bar).alias("passed"), _scores("routing_accuracy", "supporting_recall"))


def run_corpora(
    spark: SparkSession,
    store: str,
    run: str,
    intents: str,
    labels: str,
    predict: Callable[[DataFrame], DataFrame],
    routing: str | None = None,
    route: Callable[[DataFrame], DataFrame] | None = None,
    bar: float = BAR,
) -> DataFrame:
    """Evaluate the corpora at ``intents`` and ``routing``, store the report of ``run``, each case and each label's figures under ``store``; gives the metrics that fell.

    A run's cases and labels are in folders of its name and replace what they hold.
    """
    results = intent_results(evaluation.read_cases(spark, intents), evaluation.read_label_groups(spark, labels), predict)
    results.write.mode("overwrite").parquet(f"{store}/cases/run={run}")
    results = spark.read.schema(results.schema).parquet(f"{store}/cases/run={run}")
    evaluate.per_class(results, "expected_intent", "label").write.mode("overwrite").parquet(f"{store}/labels/run={run}")
    scores = intent_scores(results, bar)
    if routing and route:
        scores = scores.unionByName(routing_scores(routing_results(evaluation.read_cases(spark, routing, evaluation.ROUTING_CASES), route), bar))
    return evaluation.store_run(evaluation.report(scores, run), f"{store}/runs")
