"""Set similarities over arrays, as columns. Nulls count as empty sets; policies for empty sets are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia import vocab


def as_set(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))


def jaccard(a, b, both_empty: float = 0.5, one_empty: float = 0.0) -> Column:
    """|a & b| / |a | b|, with a value for two empty sets and one for one empty set."""
    a, b = as_set(a), as_set(b)
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    ratio = F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.when(empty == 2, F.lit(both_empty)).when(empty == 1, F.lit(one_empty)).otherwise(ratio)


def once(value: Column, body) -> Column:
    """body of a value that is worked out once: as the only element of an array that a lambda takes apart. A column that a
    lambda names is worked out again for each of its elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def mapping(of: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def contained(text: Column, words) -> Column:
    """The words that a text contains, in the list's order; none of a null text."""
    return F.filter(literals(words), lambda w: F.contains(F.coalesce(text, F.lit("")), w))


def specific(tag: Column) -> Column:
    return F.exists(literals([w.lower() for w in vocab.SPECIFIC_INTERVENTIONS]), lambda w: F.contains(F.lower(tag), w))


def intervention_weight(tag: Column) -> Column:
    return F.when(specific(tag), 3.0).when(tag.isin(vocab.GENERIC_INTERVENTIONS), 0.35).otherwise(1.0)


def weighted_jaccard(a, b, weight=intervention_weight) -> Column:
    """Weights of common members over weights of all; 0.5 for two empty sets, 0 for one."""
    a, b = as_set(a), as_set(b)
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda t, x: t + weight(x))
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, 0.5).when(empty == 1, 0.0).otherwise(total(F.array_intersect(a, b)) / F.nullif(total(F.array_union(a, b)), F.lit(0.0)))
