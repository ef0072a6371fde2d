"""Hard-negative mining by segment summaries.

Vectors are cut into segments; of each segment its mean and its deviation (root of the summed squares around the mean)
are stored beside the vector.  For a segment of n components, x.y = n mean(x) mean(y) + r with |r| <= dev(x) dev(y), so
sums over segments bound a score from both sides.  A search starts with one segment a vector, then refines those vectors
that may still matter to 4 and to 16 segments (`LEVELS`), and only then scores exactly.  The coarser summaries follow
from the finest by the rule for joined variances.

A search has windows of scores and wants the `k` best in each.  What is known of a window's kth score raises its lower
end: first within one shard, by scoring the rows with the best estimates at once; then, between the two rounds, the kth
score of the anchor's own shard limits the search of all other shards.

1. Positives: the rows of the anchor's label, one window without ends, k = 5.
2. Negatives: the rows of other labels, for each score p of a positive one window from 50 % to 95 % of p, k = 3.

Rows are dealt into shards of about `SHARD_ROWS`, anchors into blocks of at most about `BLOCK_ROWS`; a task has one block
and one shard, whatever the labels, so no label is hot.  Equal rows are counted before they are dealt; a row that is there
several times takes several places.  Components are floor(scale * x), so scores are whole numbers, exact below 2**53.

Rows with a null id, label or vector, an empty vector or a null or non-finite component take no part; vectors of different
lengths don't meet.  Equal anchor rows count once; rows with the anchor's own id are neither its positives nor negatives.
Ties go to the smaller id.  A positive below zero has no window.  An empty table gives an empty result; extra columns take
no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

LEVELS = (1, 4, 16)
SHARD_ROWS = 8192
BLOCK_ROWS = 8192
#: Anchors whose coarsest bounds are taken together, and rows scored at once for a first kth score.
TOGETHER = 64
PROBE = 64
_FOUND = "anchor_no long, anchor_id long, window_no int, vec_id long, copies int, score long"


def summaries(points: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each of `segments` equal segments; vectors are lengthened by zeros to fit."""
    width = -(-points.shape[1] // segments)
    padded = np.zeros((len(points), segments * width))
    padded[:, :points.shape[1]] = points
    parts = padded.reshape(len(points), segments, width)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))


def coarser(means: np.ndarray, devs: np.ndarray, width: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of `segments` segments from those of finer segments of `width` components."""
    m, d = (x.reshape(len(x), segments, -1) for x in (means, devs))
    mean = m.mean(axis=2)
    return mean, np.sqrt((d ** 2).sum(axis=2) + width * ((m - mean[:, :, None]) ** 2).sum(axis=2))


class Shard:
    """The vectors of one task with their summaries at all levels."""

    def __init__(self, points: np.ndarray, means: np.ndarray, devs: np.ndarray, size: int):
        self.points, self.levels = points, []
        fine = -(-size // LEVELS[-1])
        for segments in LEVELS:
            m, d = (means, devs) if segments == LEVELS[-1] else coarser(means, devs, fine, segments)
            # with weights, the middle of the bounds is one product of rows and the reach another
            self.levels.append((m * math.sqrt(fine * LEVELS[-1] / segments), d))

    def bounds(self, level: int, other: Shard, rows, mine) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible scores of this shard's rows `mine` with the rows `rows` of `other`."""
        m, d = self.levels[level]
        om, od = other.levels[level]
        middle, reach = m[mine] @ om[rows].T, d[mine] @ od[rows].T
        reach += 1 + 1e-9 * (np.abs(middle) + reach)
        return middle - reach, middle + reach


class _Windows:
    """The k best rows of each window of one anchor, so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.best: list[list[tuple[float, int, int]]] = [[] for _ in low]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        for w, (low, high) in enumerate(zip(self.low, self.high)):
            hit = np.flatnonzero((scores >= low) & (scores <= high))
            if not len(hit):
                continue
            if len(hit) > self.k:
                order = np.lexsort((ids[at[hit]], -scores[hit]))[:self.k]
                hit = hit[order]
            both = self.best[w] + [(-float(scores[i]), int(ids[at[i]]), int(copies[at[i]])) for i in hit]
            both.sort()
            filled, kept = 0, []
            for item in both:
                if filled >= self.k:
                    break
                kept.append(item)
                filled += item[2]
            self.best[w] = kept
            if filled >= self.k:
                self.low[w] = max(low, -kept[-1][0])


def _mined(anchors: Shard, a: int, rows: Shard, may: np.ndarray, low0, high0, w: _Windows, ids, copies) -> None:
    """Search the rows `may` (their bounds at the coarsest level are `low0`, `high0`) for the windows `w` of anchor `a`."""
    def narrowed(at, low, high):
        keep = (high >= w.low.min()) & (low <= w.high.max())
        return at[keep], low[keep], high[keep]

    at, low, high = narrowed(may, low0, high0)
    for level in range(1, len(LEVELS)):
        if not len(at):
            return
        low, high = (x.ravel() for x in anchors.bounds(level, rows, at, slice(a, a + 1)))
        if level == 1 and len(at) > 2 * PROBE:
            # a first kth score from the rows whose middle is highest, or nearest below the windows' upper end
            middle = (low + high) / 2
            middle = np.where(middle <= w.high.max(), middle, -np.abs(middle))
            probe = np.argpartition(middle, len(at) - PROBE)[-PROBE:]
            w.add(at[probe], rows.points[at[probe]] @ anchors.points[a], ids, copies)
            rest = np.ones(len(at), bool)
            rest[probe] = False
            at, low, high = at[rest], low[rest], high[rest]
        at, low, high = narrowed(at, low, high)
    if len(at):
        w.add(at, rows.points[at] @ anchors.points[a], ids, copies)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(table.num_rows, -1)


def _meet(k: int, same_label: bool):
    def meet(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if anchors.num_rows and shard.num_rows:
            shard = shard.sort_by([("label", "ascending"), ("vec_id", "ascending")])
            size = len(shard.column("vector")[0])
            mine, rows = (Shard(*(_matrix(t, c) for c in ("vector", "means", "devs")), size) for t in (anchors, shard))
            ids, copies, labels = (shard.column(c).to_numpy() for c in ("vec_id", "copies", "label"))
            own, no, label = (anchors.column(c).to_numpy() for c in ("anchor_id", "anchor_no", "label"))
            lows, highs = anchors.column("low").to_pylist(), anchors.column("high").to_pylist()
            first, last = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
            everything = np.arange(shard.num_rows)
            for start in range(0, anchors.num_rows, TOGETHER):
                block = slice(start, start + TOGETHER)
                low0, high0 = mine.bounds(0, rows, everything, block)
                for a in range(start, min(start + TOGETHER, anchors.num_rows)):
                    s, e = first[a], last[a]
                    may = everything[s:e] if same_label else np.concatenate([everything[:s], everything[e:]])
                    may = may[ids[may] != own[a]]
                    w = _Windows(np.array(lows[a], float), np.array(highs[a], float), k)
                    _mined(mine, a, rows, may, low0[a - start][may], high0[a - start][may], w, ids, copies)
                    for i, best in enumerate(w.best):
                        for score, vec, times in best:
                            for column, value in zip(out, (int(no[a]), int(own[a]), i, vec, min(times, k), round(-score))):
                                column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                        names=["anchor_no", "anchor_id", "window_no", "vec_id", "copies", "score"])
    return meet


def _with_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.asarray(batch.column("size"))
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            m, d = summaries(_matrix(pa.Table.from_batches([part]), "vector"), LEVELS[-1])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), LEVELS[-1]).cast(pa.list_(pa.float64())) for x in (m, d)]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "means", "devs"])


def summarised(vectors: DataFrame, scale: float) -> DataFrame:
    """Distinct rows that take part, how often each is there, and the summaries of its finest segments."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0").where(finite)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))
    rows = rows.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    return rows.select("vec_id", "label", "vector", F.least("copies", F.lit(2 ** 31 - 1)).cast("int").alias("copies"),
                       F.size("vector").alias("size")).mapInArrow(
        _with_summaries, "vec_id long, label long, vector array<double>, copies int, size int, "
                         "means array<double>, devs array<double>")


class _Grid:
    """All rows in shards, and anchors in blocks, which a search brings together."""

    def __init__(self, rows: DataFrame, every: int):
        is_anchor = F.col("vec_id") % every == 0
        count = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).first()
        self.shards, self.blocks = (max(1, math.ceil(n / most)) for n, most in (
            (count["n"], SHARD_ROWS), (count["a"], BLOCK_ROWS)))
        number = F.xxhash64("vec_id", "label", "vector")
        self.rows = rows.withColumn("shard", F.pmod(number, F.lit(self.shards)).cast("int"))
        self.dealt = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        self.anchors = stored(self.rows.where(is_anchor).drop("copies").withColumn("anchor_no", number).withColumnRenamed(
            "vec_id", "anchor_id").withColumn("block", F.pmod(F.xxhash64("anchor_no"), F.lit(self.blocks)).cast("int")), "anchors")

    def _searched(self, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
        key = ["size", "shard", "block"]
        return anchors.groupBy(*key).cogroup(self.dealt.groupBy(*key)).applyInArrow(_meet(k, same_label), _FOUND)

    def best(self, anchors: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
        """The rows of each window by falling score, then id, with their `place` in it; all `k` and a few more."""
        home = found = stored(self._searched(anchors, k, same_label), name)
        if self.shards > 1:
            known = home.groupBy("anchor_no", "anchor_id", "window_no").agg(
                F.when(F.sum("copies") >= k, F.min("score").cast("double")).alias("kth"))
            known = known.where("kth IS NOT NULL").groupBy("anchor_no", "anchor_id").agg(
                F.map_from_entries(F.collect_list(F.struct("window_no", "kth"))).alias("kth"))
            raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at(F.col("kth"), i), x)))
            away = anchors.join(known, ["anchor_no", "anchor_id"], "left").withColumn("low", raised).drop("kth")
            away = away.withColumn("home", F.col("shard")).withColumn(
                "shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1)))).where("shard <> home").drop("home")
            found = home.unionByName(self._searched(away, k, same_label))
        one_each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
        return one_each.withColumn("place", F.row_number().over(Window.partitionBy(
            "anchor_no", "anchor_id", "window_no").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)


def mined(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95),
          scale: float = 256.0) -> DataFrame:
    """The hardest negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id and both scores."""
    grid = _Grid(stored(summarised(vectors, scale), "summaries"), every)
    any_score = [F.array(F.lit(x)).alias(c) for x, c in ((-math.inf, "low"), (math.inf, "high"))]
    near = stored(grid.best(grid.anchors.select("*", *any_score), positives, True, "near"), "positives")
    near = near.where("score >= 0").select("anchor_no", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias(
        "positive_score"), "place")
    wanted = near.groupBy("anchor_no", "anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("wanted"))
    low = F.transform("wanted", lambda p: F.ceil(p * percent[0] / 100).cast("double")).alias("low")
    high = F.transform("wanted", lambda p: F.floor(p * percent[1] / 100).cast("double")).alias("high")
    anchors = grid.anchors.join(wanted, ["anchor_no", "anchor_id"])
    anchors = stored(anchors.select(*grid.anchors.columns, low, high), "windows")
    hard = grid.best(anchors, negatives, False, "hard").join(
        wanted, ["anchor_no", "anchor_id"]).withColumn("positive_score", F.get("wanted", F.col("window_no")))
    return near.drop("place").join(hard, ["anchor_no", "anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
