"""Predicates that decide what happens to a message or a tool call, over word lists given as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

#: The types of a variant that each declared type takes; a boolean passes as an integer or a number.
_TAKES = {
    "string": "^STRING$",
    "integer": "^(BIGINT|BOOLEAN)$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
}


def any_of(text: Column, keywords: Sequence[str]) -> Column:
    """Whether a keyword occurs in the lower-cased text."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords], F.lit(False))


def needs_knowledge(text: Column, label: Column, never: Sequence[str], always: Sequence[str], greetings: Sequence[str], keywords: Sequence[str], least: int = 4) -> Column:
    """Whether a message is looked up: by its label where a list names it, else by its length and words; null and blank never."""
    body = F.lower(strip(F.coalesce(text, F.lit(""))))
    rest = (F.length(body) >= least) | any_of(body, keywords)
    return F.when(body == "", False).when(label.isin(*never), False).when(label.isin(*always), True).when(body.isin(*greetings), False).otherwise(rest)


def needs_clarification(text: Column, label: Column, confidence: Column, other: str = "other", below: float = 0.5) -> Column:
    """Whether to ask back: no label, more than two characters, low confidence."""
    return (label == other) & (F.length(strip(F.coalesce(text, F.lit("")))) > 2) & (confidence < below)


def escalates(response: Column, urgency: Column, label: Column, keywords: Sequence[str], labels: Sequence[str], critical: int = 4) -> Column:
    """Whether a person takes over: by the response's words, the urgency or the label."""
    return any_of(F.coalesce(response, F.lit("")), keywords) | (urgency == critical) | label.isin(*labels)


def param_problem(params: Column, required: Sequence[str], types: Mapping[str, str]) -> Column:
    """The first problem of a JSON object of parameters, or the empty string.

    Required names come first, then types; names without a declared type pass. Text that is no
    JSON has none of the names.
    """
    v = F.try_parse_json(params)

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

    found = [F.when(kind(n).isNull(), f"missing {n}") for n in required]
    found += [F.when(kind(n).isNotNull() & ~kind(n).rlike(_TAKES[t]), f"{n} is no {t}") for n, t in types.items()]
    return F.coalesce(*found, F.lit(""))
