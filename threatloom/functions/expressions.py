"""Small helpers for composing Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Inside a higher-order function an expression is evaluated again for every element; binding it
    to a lambda variable keeps nested array work linear.
    """
    return F.transform(F.array(value), body)[0]


def any_of(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def empty_array(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that they are evaluated exactly once per row.

    Filters on a projected column are pushed below the projection and evaluate it again, and so does the
    filter Spark infers when the column is exploded. Neither passes a generator, so the columns come out of
    one that makes a single row.
    """
    fields = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(fields)))
