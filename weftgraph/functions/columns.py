"""Column expressions that several operators and queries share. Each is a plain expression and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried one after another.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy")
#: Terms of edge names by kind of hierarchy.
HIERARCHY = {"containment": ("contains", "has", "in_"), "ownership": ("owns", "placed", "belongs"), "supply": ("supplies", "produces")}


def parse_time(text: Column) -> Column:
    """The first format that fits, as a timestamp without zone; a zone at the end is dropped. Null if none fits."""
    plain = F.regexp_replace(F.trim(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])


def naming_score(uniqueness: Column, present: Column, total: Column, mean_length: Column) -> Column:
    """How well a property names its nodes: 10 if unique, 5 if variable, a tenth of its presence in percent, 2 for short values."""
    return F.when(uniqueness == "unique", 10.0).when(uniqueness == "variable", 5.0).otherwise(0.0) + present / total * 10 + F.when(mean_length <= 30, 2.0).otherwise(0.0)


def naming_style(name: Column) -> Column:
    return F.when(name.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake_case").when(name.rlike("^[a-z]+[A-Z]"), "camelCase").when(name.rlike("^[A-Z][a-z]"), "PascalCase").when(name.rlike("^[a-z0-9]+$"), "lower").otherwise("other")


def hierarchy_kind(edge_type: Column) -> Column:
    found = F.lit("other")
    for kind, terms in reversed(HIERARCHY.items()):
        told = F.lit(False)
        for t in terms:
            told = told | F.contains(F.lower(edge_type), F.lit(t))
        found = F.when(told, kind).otherwise(found)
    return found


def activity(n: Column) -> Column:
    """The class of a channel by its measurements."""
    return F.when(n.isNull(), "missing").when(n == 0, "none").when(n <= 2, "low").when(n <= 9, "medium").otherwise("high")


def span_label(days: Column) -> Column:
    return F.when(days < 1, "hours").when(days < 7, "days").when(days < 31, "weeks").when(days < 366, "months").otherwise("years")


def binary_round(x: Column, digits: int) -> Column:
    """A double rounded to `digits` digits as it is stored, as SQL engines do: 0.5005 is a little less than that and gives 0.5, where
    `round` goes by the decimals that it is written with and gives 0.501."""
    return F.round(x * 10.0**digits) / 10.0**digits
