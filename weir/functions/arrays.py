"""Column functions on vectors and item sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Dot product; different lengths are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(
        F.raise_error(F.lit("vector and projection differ in length")).cast("double")
    )


def inner_products(vector: Column, rows: Sequence[Sequence[float]]) -> Column:
    """Array of the dot products of ``vector`` with each constant row."""
    return F.array(*[inner_product(vector, F.array(*[F.lit(float(x)) for x in r])) for r in rows])


def subsets(items: str) -> Column:
    """All subsets of an array column, the empty one first, in bit-mask order.

    2^n arrays leave one row: for short arrays. ``expand_subsets`` cuts long ones.
    """
    # Doubling: the subsets without x, then the same ones with x appended.
    return F.expr(
        f"aggregate({items}, array(slice({items}, 1, 0)), (acc, x) -> concat(acc, transform(acc, s -> array_append(s, x))))"
    )


def drop_one_subsets(items: str) -> Column:
    """The n subsets that leave out exactly one item; empty for a single item."""
    none = f"filter(array({items}), x -> false)"
    made = f"transform(sequence(0, size({items}) - 1), d -> filter({items}, (x, i) -> i <> d))"
    return F.expr(f"if(size({items}) < 2, {none}, {made})")


def joined(items: Column | str, sep: str = ",") -> Column:
    """Text form of an id array."""
    c = F.col(items) if isinstance(items, str) else items
    return F.array_join(c.cast("array<string>"), sep)
