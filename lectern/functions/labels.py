"""Column expressions over 0/1 category columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def none_label(categories) -> Column:
    """1 when no category is set (nulls count as 0), else 0."""
    total = reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in categories])
    return (total == 0).cast("int")


def or_label(*cols) -> Column:
    """1 when any of the columns is 1; nulls count as 0."""
    total = reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in cols])
    return (total >= 1).cast("int")


def label_list(categories) -> Column:
    """Names of the set categories, in category order."""
    return F.array_compact(F.array(*[F.when(_c(c) == 1, F.lit(c)) for c in categories]))


def class_to_id(categories) -> Column:
    """``map(category -> position)``."""
    cats = F.array(*[F.lit(c) for c in categories])
    return F.map_from_arrays(cats, F.sequence(F.lit(0), F.lit(len(categories) - 1)))


def id_to_class(categories) -> Column:
    """The inverse map, ``map(position -> category)``."""
    cats = F.array(*[F.lit(c) for c in categories])
    return F.map_from_arrays(F.sequence(F.lit(0), F.lit(len(categories) - 1)), cats)


def multi_hot(names, categories) -> Column:
    """Array of 0.0/1.0 in category order from an array of category names."""
    n = _c(names)
    return F.transform(F.array(*[F.lit(c) for c in categories]),
                       lambda c: F.array_contains(n, c).cast("double"))


def names_from_multi_hot(vec, categories) -> Column:
    """Back from a multi-hot array to the list of names (via the id -> class map)."""
    inv = id_to_class(categories)
    idx = F.filter(F.sequence(F.lit(0), F.size(_c(vec)) - 1), lambda i: F.get(_c(vec), i) == 1.0)
    return F.transform(idx, lambda i: F.element_at(inv, i))


def combination_key(categories, sep: str = "_") -> Column:
    """``'0_1_0…'`` string of the label values, the stratification key of a label set."""
    return F.concat_ws(sep, *[F.coalesce(_c(c), F.lit(0)).cast("string") for c in categories])
