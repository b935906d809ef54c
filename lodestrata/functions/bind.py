"""Values that an expression or a plan names many times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value's expression in the plan once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each computed once a row.

    What follows names attributes: the optimizer does not copy the expressions into later ones or into filters, so
    plans grow with the steps and not with a product of their references.
    """
    kept = [c for c in df.columns if c not in columns]
    one = F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.select(*kept, one.alias("__bound")).select(*kept, "__bound.*")
