"""Ordered scans that do not put a whole key into one task.

A window partitioned by key sends every row of that key to one task.  Here each
key is cut into blocks of consecutive rows; the window runs inside a block, one
summary row per block is carried along the key, and the two are joined on
(key, block).  A key that holds a third of the table is spread over as many
tasks as it has blocks.

All values wanted of one order belong into one scan: it evaluates its input
twice, once for the rows and once, with the columns of the summary only, for
the summaries.  Values that build on the row before (runs, and what opened
them) are scans of their own kind, so that they need no second scan over the
first.  Where several scans must follow each other, or the input is costly,
write it down between them (`lectern.session.written`).

Blocks come from a column that never decreases along the order, or, where
nothing bounds the rows that share such a value, from ranges of equal size:
without a block the rows are dealt by range of (keys, order) and written once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import written

BLOCK_ROWS = 1 << 16
_BLOCK = "__block"


@dataclass(frozen=True)
class Scan:
    """One value to carry along the order: `kind` of `value`, stored as `out`."""

    kind: str
    value: Column
    out: str
    step: Callable[[Column, Column], Column] | None = None
    keep: Column | None = None


def running_sum(value: Column, out: str) -> Scan:
    """Sum of `value` up to and including the row."""
    return Scan("sum", value, out)


def max_before(value: Column, out: str) -> Scan:
    """Greatest non-null `value` strictly before the row, NULL without one."""
    return Scan("max_before", value, out)


def sum_before(value: Column, out: str) -> Scan:
    """Sum of `value` over the rows before this one, 0 at the start."""
    return Scan("sum_before", value, out)


def previous(value: Column, out: str) -> Scan:
    """`value` of the row just before."""
    return Scan("lag", value, out)


def following(value: Column, out: str) -> Scan:
    """`value` of the row just after."""
    return Scan("lead", value, out)


def last_known(value: Column, out: str) -> Scan:
    """Latest non-null `value` at or before the row."""
    return Scan("ffill", value, out)


def last_known_before(value: Column, out: str) -> Scan:
    """Latest non-null `value` strictly before the row."""
    return Scan("ffill_before", value, out)


def next_known_after(value: Column, out: str) -> Scan:
    """Earliest non-null `value` strictly after the row."""
    return Scan("bfill_after", value, out)


def running_steps(value: Column, step: Callable[[Column, Column], Column], out: str) -> Scan:
    """Sum of `step(before, value)` up to and including the row.

    `before` is a struct with the previous row's value as `v`; it is NULL for the first row of a key.
    """
    return Scan("steps", value, out, step)


def kept_since(value: Column, opens: Callable[[Column, Column], Column], keep: Column, out: str) -> Scan:
    """`keep` of the latest row, this one included, for which `opens(before, value)` holds."""
    return Scan("since", value, out, opens, keep)


def block_of(position: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer position."""
    return F.floor(position / F.lit(rows)).cast("bigint")


def time_block(ts: Column, seconds: int) -> Column:
    """Block number of a timestamp: `seconds`-wide slices of time."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def dealt_by_range(df: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    """`df` in ranges of about equal size along (`keys`, `order`), numbered in `out`.

    The dealt rows are written, so that a task that runs again can't see other ranges.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    return written(df.repartitionByRange(*columns).withColumn(out, F.spark_partition_id().cast("bigint")), "ranges")


def ordered_scan(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, scans: list[Scan]
) -> DataFrame:
    """Add the columns of `scans` to `df`, per key, in the total order `order`.

    `block` must never decrease along `order` and should bound the number of
    rows that share one value (see `block_of`, `time_block`); without one, rows
    are dealt by range.
    """
    base = dealt_by_range(df, keys, order, _BLOCK) if block is None else df.withColumn(_BLOCK, block)
    parts = [*keys, _BLOCK]
    inside = Window.partitionBy(*parts).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    after = inside.rowsBetween(1, Window.unboundedFollowing)
    along = Window.partitionBy(*keys).orderBy(_BLOCK)
    blocks_so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks_before = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks_after = along.rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(*order)
    boxed = lambda v: F.struct(v.alias("v"))

    edges, local, summary, across, offset, final = {}, {}, {}, {}, {}, {}
    for i, scan in enumerate(scans):
        l, s, o = f"__l{i}", f"__s{i}", f"__o{i}"
        v = scan.value
        known = F.when(v.isNotNull(), at)
        if scan.kind == "sum":
            local[l], summary[s] = F.sum(v).over(so_far), F.sum(v)
            offset[o] = F.sum(s).over(blocks_before)
            final[scan.out] = F.coalesce(F.col(l) + F.col(o), F.col(l), F.col(o))
        elif scan.kind == "max_before":
            local[l], summary[s] = F.max(v).over(before), F.max(v)
            offset[o] = F.max(s).over(blocks_before)
            final[scan.out] = F.greatest(F.col(l), F.col(o))
        elif scan.kind == "sum_before":
            local[l], summary[s] = F.sum(v).over(before), F.sum(v)
            offset[o] = F.sum(s).over(blocks_before)
            final[scan.out] = F.coalesce(F.col(l) + F.col(o), F.col(l), F.col(o), F.lit(0))
        elif scan.kind in ("lag", "lead"):
            step = F.lag if scan.kind == "lag" else F.lead
            edge = F.max_by if scan.kind == "lag" else F.min_by
            local[l], summary[s] = step(boxed(v)).over(inside), edge(boxed(v), at)
            offset[o] = step(s).over(along)
            final[scan.out] = F.coalesce(F.col(l), F.col(o))["v"]
        elif scan.kind in ("ffill", "ffill_before"):
            frame = so_far if scan.kind == "ffill" else before
            local[l], summary[s] = F.last(v, ignorenulls=True).over(frame), F.max_by(v, known)
            offset[o] = F.last(s, ignorenulls=True).over(blocks_before)
            final[scan.out] = F.coalesce(F.col(l), F.col(o))
        elif scan.kind == "bfill_after":
            local[l], summary[s] = F.first(v, ignorenulls=True).over(after), F.min_by(v, known)
            offset[o] = F.first(s, ignorenulls=True).over(blocks_after)
            final[scan.out] = F.coalesce(F.col(l), F.col(o))
        elif scan.kind in ("steps", "since"):
            # Inside a block the row before is at hand; the step into its first row is taken between the summaries.
            p, f, e, d = f"__p{i}", f"__f{i}", f"__e{i}", f"__d{i}"
            edges[p] = F.lag(boxed(v)).over(inside)
            inner = F.when(F.col(p).isNotNull(), scan.step(F.col(p), v))
            summary[f], summary[e] = F.min_by(boxed(v), at), F.max_by(boxed(v), at)
            across[d] = scan.step(F.lag(e).over(along), F.col(f)["v"])
            if scan.kind == "steps":
                local[l], summary[s] = F.sum(inner).over(so_far), F.sum(inner)
                offset[o] = F.sum(d).over(blocks_so_far) + F.coalesce(F.sum(s).over(blocks_before), F.lit(0))
                final[scan.out] = F.col(o) + F.coalesce(F.col(l), F.lit(0))
            else:
                k = f"__k{i}"
                local[l] = F.last(F.when(inner, boxed(scan.keep)), ignorenulls=True).over(so_far)
                summary[s], summary[k] = F.max_by(boxed(scan.keep), F.when(inner, at)), F.min_by(boxed(scan.keep), at)
                own = F.when(F.col(d), F.col(k))
                offset[o] = F.coalesce(own, F.last(F.coalesce(F.col(s), own), ignorenulls=True).over(blocks_before))
                final[scan.out] = F.coalesce(F.col(l), F.col(o))["v"]
        else:
            raise ValueError(f"unknown scan {scan.kind!r}")

    named = lambda columns: [c.alias(n) for n, c in columns.items()]
    if edges:
        base = base.select("*", *named(edges))
    carried = base.groupBy(*parts).agg(*named(summary))
    if across:
        carried = carried.select("*", *named(across))
    carried = carried.select(*parts, *named(offset))
    joined = base.select("*", *named(local)).join(carried, parts, "left")
    kept = [c for c in df.columns if c not in final]
    return joined.select(*kept, *named(final))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], block: Column | None, out: str) -> DataFrame:
    """Dense 1-based numbering per key, as `row_number` but block-wise."""
    return ordered_scan(df, keys, order, block, [running_sum(F.lit(1).cast("bigint"), out)])


def islands(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: Column, out: str
) -> DataFrame:
    """Number the runs of consecutive rows with an equal `value` (from 1)."""
    change = lambda before, now: F.when(
        before.isNotNull() & before["v"].eqNullSafe(now), 0).otherwise(1).cast("bigint")
    return ordered_scan(df, keys, order, block, [running_steps(value, change, out)])


def merged_runs(
    df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: Column, totals: dict[str, Column]
) -> DataFrame:
    """One row per run of equal values: its number, its value and the given aggregates.

    Rows of a run are combined on the map side, so a run of any length stays cheap.
    """
    numbered = islands(df.withColumn("run_value", value), keys, order, block, F.col("run_value"), "run_no")
    return numbered.groupBy(*keys, "run_no", "run_value").agg(*[c.alias(n) for n, c in totals.items()])
