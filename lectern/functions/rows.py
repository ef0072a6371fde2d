"""Array columns → rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered_rows(df: DataFrame, keys: list, array: Column | str, position: str, value: str) -> DataFrame:
    """One row per element with its 0-based position.

    The outer form is used on purpose.  For a plain explode the optimizer adds
    `size(array) > 0` below it, written out as the whole array expression, so
    a costly array would be computed twice (and inside its own lambdas again).
    """
    return df.select(*keys, F.posexplode_outer(array).alias(position, value)).filter(F.col(position).isNotNull())


def plain_rows(df: DataFrame, keys: list, array: Column | str, value: str) -> DataFrame:
    """One row per element, order not kept as a column."""
    return numbered_rows(df, keys, array, "__n", value).drop("__n")
