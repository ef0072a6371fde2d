"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FILLERS = 1009


def optional_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """Left join whose first key, a string, is NULL in many left rows.

    All NULL keys hash alike, so those rows would meet in one task although
    none of them can match.  They get one of many filler keys instead, chosen
    from `spread_by`, which no right row can have.
    """
    key = on[0]
    filler = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*spread_by), F.lit(_FILLERS)).cast("string"))
    keyed = left.withColumn("__key", F.coalesce(F.col(key), filler))
    return keyed.join(right.withColumnRenamed(key, "__key"), ["__key", *on[1:]], "left").drop("__key")
