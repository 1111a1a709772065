r"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measure`` adds the base measures of a text. ``cascade`` runs rules on a bounded sample, times each
and takes its rejection rate, orders them by rejections per second and evaluates them as one CASE
expression, so a document is judged by the cheap and sharp rules first and by no rule after one
that rejects it. The order changes the work and never the verdict.

Words are runs of anything but blank and the bytes 9 to 13. Defined results: null text has no words
and every measure is 0, as for an empty text; such a document fails the base; rows that repeat are
judged each; ties in rejection per cost go by name; an empty table gives an empty result and keeps
the given order; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, settle

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean column over the columns of ``measure``."""

    name: str
    rejects: Callable[[], Column]


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _matches(pattern: str) -> Column:
    return F.regexp_count("q_text", F.lit(pattern))


RULES = (
    Rule("word_length", lambda: ~_ratio(F.col("word_chars"), F.col("n_words")).between(2, 15)),
    Rule("symbols", lambda: _ratio(F.col("n_symbols"), F.col("n_words")) > 0.1),
    Rule("repeated_lines", lambda: _ratio(F.col("n_dup_lines"), F.col("n_lines")) > 0.3),
    Rule("few_letters", lambda: _ratio(_matches(r"\p{L}"), F.col("word_chars")) < 0.6),
    Rule("shouting", lambda: _ratio(_matches(r"\p{Lu}"), F.col("word_chars")) > 0.5),
    Rule("bullets", lambda: _ratio(_matches(r"(?m)^[ \t]*[-*•]"), F.col("n_lines")) > 0.9),
    Rule("ellipses", lambda: _ratio(_matches(r"(?m)(?:\.\.\.|…)[ \t]*$"), F.col("n_lines")) > 0.3),
)


def _repeat_words() -> Column:
    """Words in windows of five words that stand twice or more in the text; columns q_windows, q_sorted."""
    at = F.col("q_sorted")
    repeated = F.filter(
        at,
        lambda x, i: ((i > 0) & (F.get(at, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(at, i + 1)["h"] == x["h"], F.lit(False))),
    )
    places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(WINDOW))).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size("q_sorted") > 0, covered).otherwise(0).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, q_text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("q_text"))
    df = df.withColumn("q_words", F.array_remove(F.split("q_text", WORD_BREAK), ""))
    df = df.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({"q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)), "n_words": F.size("q_words").cast("long")})
    some = F.col("n_words") >= WINDOW
    window = F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[F.get(F.col("q_hashes"), i + k) for k in range(WINDOW)]),
    )
    df = df.withColumn("q_windows", F.when(some, window))
    twice = F.size("q_windows") > F.size(F.array_distinct("q_windows"))
    df = df.withColumn(
        "q_sorted",
        F.when(some & twice, F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    return df.select(
        "doc_id",
        "q_text",
        "n_words",
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> list[Rule]:
    """The rules by rejections per second, most first, from about ``sample`` documents.

    A rule's cost is the time of a scan of the sample that evaluates it, less that of a bare scan.
    """
    some = bounded_sample(docs.select("doc_id", "text").withColumn("every", F.lit(0)), "every", "doc_id", sample)
    seen = settle(measure(some), "rule-sample")

    def timed(c: Column) -> tuple[float, float]:
        began = time.perf_counter()
        rejected = seen.agg(F.avg(c.cast("double"))).first()[0]
        return time.perf_counter() - began, rejected or 0.0

    timed(F.length("q_text") < 0)  # warms up
    bare, _ = timed(F.length("q_text") < 0)
    found = {r.name: timed(r.rejects()) for r in rules}
    return sorted(rules, key=lambda r: (-found[r.name][1] / max(found[r.name][0] - bare, 1e-3), r.name))


def cascade(measured: DataFrame, rules: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only where the ones before it do not reject."""
    verdict = F.when(base_failed(), F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.rejects(), F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    measured = measure(docs)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), cascade(measured, order_rules(docs, rules)).alias("kept")
    )
