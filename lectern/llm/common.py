"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import scratch_path

#: The six ASCII white-space characters; all else belongs to a word.
GAPS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, also where `body` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later uses neither recompute nor depend on executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one among those with equal `by`, ordered by `order`.

    Rows are dealt by range of (`by`, `order`), so a `by` with a third of all rows is spread over many tasks.  Each
    range is summed by itself, and the totals of the ranges, a few numbers per task, are summed along `by`.  The dealt
    rows are written, so that a lost executor can't change the ranges between the two uses.  `df` should be narrow.
    Ties in `order` come in any order; give a total order where that matters.
    """
    part, base = fresh(df, "range_no"), fresh(df, "range_base")
    keys = [F.col(c) for c in by + order]
    dealt = stored(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by] + [F.col(c).isNull() for c in by]
    totals = dealt.groupBy(*by, part).agg(F.sum(value).alias(base))
    along = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(base, F.coalesce(F.sum(base).over(along), F.lit(0)))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = local[part] == totals[part]
    for c in by:
        match = match & local[c].eqNullSafe(totals[c])
    return local.join(totals, match, "left").select(
        *[local[c] for c in df.columns], (local[out] + totals[base]).alias(out))


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
