"""Intent classification and routing over dictionaries given as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (label, tier, keywords): tier 0 is tried first, tier 1 only where tier 0 has no hit.
Dictionary = Sequence[tuple[str, int, Sequence[str]]]


def keyword_hits(text: Column, dictionary: Dictionary) -> Column:
    """(label, ord, tier, hits, score) of the labels with a hit, one projection for the whole dictionary."""
    low = F.lower(text)
    items = []
    for i, (label, tier, keywords) in enumerate(dictionary):
        hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in dict.fromkeys(keywords)])
        items.append(F.struct(F.lit(label).alias("label"), F.lit(i).alias("ord"), F.lit(tier).alias("tier"), hits.alias("hits")))
    hit = F.filter(F.array(*items), lambda x: x["hits"] > 0)
    return F.transform(hit, lambda x: F.struct(x["label"].alias("label"), x["ord"].alias("ord"), x["tier"].alias("tier"), x["hits"].alias("hits"), F.least(F.lit(1.0), 0.5 + 0.25 * (x["hits"] - 1)).alias("score")))


def best_label(hits: Column, other: str = "other") -> Column:
    """(label, score) of the best hit in the first tier that has one; ties go to the first in order."""
    ranked = F.array_sort(F.transform(hits, lambda x: F.struct(x["tier"].alias("tier"), (-x["score"]).alias("neg"), x["ord"].alias("ord"), x["label"].alias("label"))))
    top = F.get(ranked, F.lit(0))
    return F.when(F.size(ranked) > 0, F.struct(top["label"].alias("label"), (-top["neg"]).alias("score"))).otherwise(F.struct(F.lit(other).alias("label"), F.lit(0.0).alias("score")))


def urgency(text: Column, label: Column, levels: Sequence[tuple[int, Sequence[str]]]) -> Column:
    """The level of the first list with a keyword in the text, else one that the label implies."""
    low = F.lower(text)
    c = None
    for level, keywords in levels:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords])
        c = F.when(hit, level) if c is None else c.when(hit, level)
    return c.when(label.isin("escalation", "human_handoff"), 3).when(label == "complaint", 2).otherwise(1)


def vote(legs: DataFrame, key: str, floor: float = 0.5, override_below: float = 0.8, generic: Sequence[str] = (), pattern_leg: int = 3) -> DataFrame:
    """(key, label, confidence) from (key, leg, weight, label, confidence).

    Weighted confidences add up by label, the smallest first, so that a sum doesn't depend on how rows arrive; ties go to the
    label of the lowest leg. A generic winner below ``override_below`` yields to a specific label of the pattern leg that has
    ``floor``; what then is below ``floor`` is "other".
    """
    parts = F.array_sort(F.collect_list(F.col("weight") * F.col("confidence")))
    score = F.when(F.size("parts") > 0, F.aggregate("parts", F.lit(0.0), lambda a, x: a + x))
    sums = legs.groupBy(key, "label").agg(parts.alias("parts"), F.min("leg").alias("first")).withColumn("score", score)
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "first", "label")
    best = sums.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "label", "score")
    pattern = legs.where(F.col("leg") == pattern_leg).select(key, F.col("label").alias("p_label"), F.col("confidence").alias("p_score"))
    out = best.join(pattern, key, "left")
    yields = F.col("label").isin(*generic) & ~F.coalesce(F.col("p_label"), F.lit("other")).isin("other", *generic) & (F.col("p_score") >= floor) & (F.col("score") < override_below)
    return out.select(
        key,
        F.when(yields, F.col("p_label")).when(F.col("score") < floor, F.lit("other")).otherwise(F.col("label")).alias("label"),
        F.when(yields, F.greatest("score", "p_score")).otherwise(F.col("score")).alias("confidence"),
    )


def vote_row(legs: Column, generic: Sequence[str] = (), specific: Sequence[str] = (), floor: float = 0.5, override_below: float = 0.8, other: str = "other") -> Column:
    """(label, confidence) of the legs that stand in one row: structs (leg, weight, label, confidence, failed) in order, the model's first, the pattern's last.

    Where the model's leg failed, the first other leg with a label and a confidence decides alone.
    Else weighted confidences add up by label; ties, to nine digits, go to the label of the lowest
    leg. A generic winner below ``override_below`` yields to a specific label of the pattern leg that
    has ``floor``; what then is below ``floor`` is ``other`` and keeps its confidence.
    """
    sums = F.transform(
        legs,
        lambda x: F.struct(F.aggregate(F.filter(legs, lambda y: y["label"] == x["label"]), F.lit(0.0), lambda a, y: a + y["weight"] * y["confidence"]).alias("score"), x["leg"].alias("leg"), x["label"].alias("label")),
    )
    best = F.get(F.array_sort(F.transform(sums, lambda x: F.struct((-F.round(x["score"], 9)).alias("neg"), x["leg"].alias("leg"), x["label"].alias("label"), x["score"].alias("score")))), F.lit(0))
    model, pattern = F.get(legs, F.lit(0)), F.get(legs, F.size(legs) - 1)
    spare = F.get(F.filter(F.slice(legs, 2, F.size(legs)), lambda x: (x["label"] != other) & (x["confidence"] > 0)), F.lit(0))
    result = lambda label, confidence: F.struct(label.alias("label"), confidence.alias("confidence"))
    yields = best["label"].isin(*generic) & pattern["label"].isin(*specific) & (pattern["confidence"] >= floor) & (best["score"] < override_below)
    return (
        F.when(model["failed"], F.coalesce(F.when(spare.isNotNull(), result(spare["label"], spare["confidence"])), result(F.lit(other), F.lit(0.0))))
        .when(yields, result(pattern["label"], F.greatest(best["score"], pattern["confidence"])))
        .when(best["score"] < floor, result(F.lit(other), best["score"]))
        .otherwise(result(best["label"], best["score"]))
    )


def known_label(label: Column, known: Sequence[str], other: str = "other") -> Column:
    """``label`` where it is a known one, else ``other``."""
    return F.when(label.isin(*known), label).otherwise(F.lit(other))


def label_group(label: Column, groups: Mapping[str, str]) -> Column:
    """The group of a label; a label without one is its own group."""
    pairs = [F.lit(x) for pair in groups.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label) if pairs else label


def domain_scores(
    text: Column,
    label: Column,
    rules: Sequence[tuple[str, float, Sequence[str], float, Sequence[str], float, float]],
    bonuses: Sequence[tuple[str, Column, float]] = (),
) -> Column:
    """(domain, ord, score): base, bonus by label, capped bonus by keyword, and the bonuses whose condition holds, in the order of the rules."""
    low = F.lower(text)
    items = []
    for i, (domain, base, labels, bonus, keywords, step, cap) in enumerate(rules):
        hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in keywords])
        score = F.lit(base) + F.when(label.isin(*labels), bonus).otherwise(0.0) + F.least(F.lit(cap), hits * F.lit(step))
        score = reduce(lambda a, b: a + F.when(b[1], b[2]).otherwise(0.0), [b for b in bonuses if b[0] == domain], score)
        items.append(F.struct(F.lit(domain).alias("domain"), F.lit(i).alias("ord"), F.round(score, 3).alias("score")))
    return F.array(*items)


def route(scores: Column, fallback: str = "general", least: float = 0.45, ratio: float = 0.55) -> Column:
    """(primary, supporting, confidence): the best domain and those close behind it."""
    ranked = F.array_sort(F.transform(scores, lambda x: F.struct((-x["score"]).alias("neg"), x["ord"].alias("ord"), x["domain"].alias("domain"))))
    top = F.get(ranked, F.lit(0))
    near = F.filter(F.slice(ranked, 2, F.greatest(F.size(ranked), F.lit(1))), lambda x: (x["domain"] != fallback) & (-x["neg"] >= least) & (-x["neg"] >= ratio * -top["neg"]))
    return F.struct(top["domain"].alias("primary"), F.array_join(F.transform(near, lambda x: x["domain"]), ",").alias("supporting"), F.round(F.least(-top["neg"], F.lit(1.0)), 3).alias("confidence"))


def route_request(
    scores: Column, urgency: Column, label: Column, confidence: Column, labels: Sequence[str], critical: int = 4, person: str = "escalation", fallback: str = "general"
) -> Column:
    """(primary, supporting, confidence, agent): a person for what is critical (1) or has an escalation label (0.8 at least), else the route by scores.

    No agent stands for the person, so ``fallback`` answers there.
    """
    by_score = route(scores, fallback)
    to_person = lambda c: F.struct(F.lit(person).alias("primary"), F.lit("").alias("supporting"), c.alias("confidence"), F.lit(fallback).alias("agent"))
    routed = F.struct(by_score["primary"].alias("primary"), by_score["supporting"].alias("supporting"), by_score["confidence"].alias("confidence"), by_score["primary"].alias("agent"))
    return F.when(urgency == critical, to_person(F.lit(1.0))).when(label.isin(*labels), to_person(F.greatest(confidence, F.lit(0.8)))).otherwise(routed)


def merge_branches(branches: DataFrame, key: str, order: str, failed: str, roles: tuple[str, str] = ("primary", "supporting")) -> DataFrame:
    """(key, response, escalated) from branches (key, order, agent, is_primary, ok, content, escalate).

    Contents that succeeded are joined, primary ones first; where none did, ``failed`` stands. A null
    ``ok`` or content is a failure. A request is escalated if any of its branches is.
    """
    part = F.format_string("[%s - %s]\n%s", F.col("agent"), F.when(F.col("is_primary"), roles[0]).otherwise(roles[1]), F.col("content"))
    good = F.col("ok") & F.col("content").isNotNull()
    item = F.when(good, F.struct((~F.col("is_primary")).alias("later"), F.col(order).alias("at"), part.alias("part")))
    out = branches.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("parts"), F.bool_or("escalate").alias("escalated"))
    text = F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n")
    return out.select(key, F.when(F.size("parts") > 0, text).otherwise(F.lit(failed)).alias("response"), "escalated")
