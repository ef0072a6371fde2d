"""State that depends on order: speed averages, runaway labels, throttled progress, latest values.

A fold over a whole key would put that key into one task.  Time is cut into
slices instead; a slice is folded on its own and only its summary travels
along the key, so the number of rows carried per key is the number of slices.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import (
    kept_since, last_known, ordered_scan, running_steps, running_sum, time_block,
)
from lectern.session import written

# Speed model, runaway limits and progress throttling.
BASE_MS = 500.0
DEFAULT_RATE_MS = 80.0
ALPHA = 0.3
WARM_WINDOW_S = 600
WARM_FLOOR_S = 25.0
RUNAWAY_FACTOR = 3.0
COLD_LIMIT_S = 300.0
WARM_SAMPLES = 3
THROTTLE_MS = 500
THROTTLE_POINTS = 1.0
STALE_MESSAGE = "Server was shut down during generation"

SLICE_S = 6 * 3600


def next_rate(rate: float | None, observed: float) -> float:
    """One step of the average, kept at three decimals.

    `float` matters: a NumPy scalar would be rounded by scaling, not exactly.
    """
    return round(float(observed if rate is None else ALPHA * observed + (1 - ALPHA) * rate), 3)


def observed_rate() -> Column:
    """Milliseconds per character beyond the fixed start-up cost; NULL for samples that do not count."""
    counts = (F.col("chars") > 0) & (F.col("duration_ms") > 0)
    return F.when(counts, F.greatest(F.col("duration_ms") - BASE_MS, F.lit(0.0)) / F.col("chars"))


def _slices(samples: DataFrame, seconds: int) -> DataFrame:
    return samples.withColumns({
        "observed": observed_rate(), "slice": time_block(F.col("ts"), seconds),
        "at_us": F.unix_micros(F.col("ts").cast("timestamp"))})


def _walk(rows: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """Spread by `keys`, sort, and stream the sorted rows through `fn`; no group is ever held in memory."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fn, schema)


def _table(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns.split(), dtype=object)


def _thousandths(rate: float) -> int:
    return round(rate * 1000)


class SpeedStep:
    """What a stretch of observations makes of the average before it: a step function on averages in thousandths.

    One step never reverses the order of two averages and shrinks their distance to 0.7 of it, up to rounding.  So after
    some sixty observations all averages that a key can have are within `CLOSE` thousandths; which start leads to which of
    them is found by bisection, and from then on only those few values are carried.  A shorter stretch is its observations.
    """

    CLOSE = 4

    def __init__(self, least: float, most: float):
        self.fresh: float | None = None  # the average of a key that had none
        self.low, self.high = round(least, 3), round(most, 3)
        self.first = _thousandths(self.low)
        self.seen: list[float] | None = []
        self.steps: list[tuple[int, float]] = []  # smallest start in thousandths, value
        self._settle(_thousandths(self.high))

    def _settle(self, last: int) -> None:
        """Replace the observations by a step function once few values are left; starts are `self.first` to `last`."""
        if self.seen is None or _thousandths(self.high) - _thousandths(self.low) > self.CLOSE:
            return
        a, end = self.first, self._after(last)
        self.steps = [(a, self._after(a))]
        while self.steps[-1][1] != end:
            value, b = self.steps[-1][1], last
            while b - a > 1:  # `a` leads to `value`, `b` beyond it
                middle = (a + b) // 2
                a, b = (middle, b) if self._after(middle) == value else (a, middle)
            self.steps.append((b, self._after(b)))
            a = b
        self.seen = None

    def _after(self, start: int) -> float:
        rate = round(start / 1000, 3)
        for x in self.seen:
            rate = next_rate(rate, x)
        return rate

    def add(self, x: float, last: int) -> None:
        """One more observation; `last` is the largest possible start in thousandths."""
        self.fresh = next_rate(self.fresh, x)
        if self.seen is not None:
            self.seen.append(x)
            self.low, self.high = next_rate(self.low, x), next_rate(self.high, x)
            self._settle(last)
        else:
            moved = [(start, next_rate(value, x)) for start, value in self.steps]
            self.steps = [s for i, s in enumerate(moved) if not i or s[1] != moved[i - 1][1]]

    def summary(self) -> tuple[float | None, list[float], list[int], list[float]]:
        return self.fresh, self.seen or [], [s for s, _ in self.steps], [v for _, v in self.steps]


def _applied(rate: float | None, fresh: float, seen: list[float], starts: list[int], values: list[float]) -> float:
    """The average after a stretch, from the one before it."""
    if rate is None:
        return fresh
    if len(starts):
        return float(values[max(0, bisect_right(list(starts), _thousandths(rate)) - 1)])
    for x in seen:
        rate = next_rate(rate, x)
    return rate


_SPEED_KEY = ["queue", "engine", "model"]
_SUMMARY = "queue engine model slice n fresh seen starts values last_us"


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One `SpeedStep` for every slice of a key; rows without an observation only make the slice known."""
    key, n, step, top, last = None, 0, None, 0, None
    summary = lambda: (*key, n, *(step.summary() if step else (None, [], [], [])), last)
    for batch in batches:
        done = []
        for *own, at, x, least, most in zip(*[batch[c].tolist() for c in (
                *_SPEED_KEY, "slice", "at_us", "observed", "low", "high")]):
            if own != key:
                if key:
                    done.append(summary())
                key, n, step, last = own, 0, None, None
            if pd.isna(x):
                continue
            if step is None:
                step, top = SpeedStep(least, most), _thousandths(round(most, 3))
            step.add(x, top)
            n, last = n + 1, at
        yield _summaries(done)
    if key:
        yield _summaries([summary()])


def _summaries(rows: list[tuple]) -> pd.DataFrame:
    return _table(rows, _SUMMARY).astype({"fresh": "Float64", "last_us": "Int64"})


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compose the step functions of each key's slices: the state at the start and at the end of every slice."""
    key, rate, seen = None, None, 0
    for batch in batches:
        rows = []
        for *own, part, n, fresh, observed, starts, values, last in zip(*[batch[c].tolist() for c in _SUMMARY.split()]):
            if own != key:
                key, rate, seen = own, None, 0
            start = (rate, seen)
            if n:
                rate, seen = _applied(rate, fresh, observed, starts, values), seen + n
            rows.append((*own, part, last, *start, rate, seen))
        yield _table(rows, "queue engine model slice last_us start_rate start_samples end_rate end_samples").astype(
            {"last_us": "Int64", "start_rate": "Float64", "end_rate": "Float64"})


def _chained(rows: DataFrame) -> DataFrame:
    """State of each key before and after every time slice; rows with `observed` NULL do not count."""
    key = "queue string, engine string, model string, slice bigint"
    summaries = _walk(
        rows.select(*_SPEED_KEY, "slice", "at_us", "event_id", "observed", "low", "high"),
        [*_SPEED_KEY, "slice"], ["at_us", "event_id"], _summarise,
        f"{key}, n bigint, fresh double, seen array<double>, starts array<bigint>, values array<double>, last_us bigint")
    return _walk(summaries, _SPEED_KEY, ["slice"], _chain,
                 f"{key}, last_us bigint, start_rate double, start_samples bigint, end_rate double, end_samples bigint")


def _with_bounds(rows: DataFrame) -> DataFrame:
    """Add the smallest and largest observation of the key, between which its average stays."""
    bounds = rows.groupBy(*_SPEED_KEY).agg(F.min("observed").alias("low"), F.max("observed").alias("high"))
    return rows.join(bounds, _SPEED_KEY)


def slice_states(samples: DataFrame, seconds: int = SLICE_S) -> DataFrame:
    """State of each key before and after every time slice that has samples."""
    return _chained(_with_bounds(_slices(samples, seconds).filter("observed IS NOT NULL")))


def speed_average(samples: DataFrame, seconds: int = SLICE_S) -> DataFrame:
    """Current average per queue, engine and model: rate, sample count, time of the last sample.

    Every sample given counts.  Of attempts, give those labelled `ok` (see `label_attempts`).
    """
    last = F.max_by(F.struct("end_rate", "end_samples", "last_us"), "slice").alias("s")
    return slice_states(samples, seconds).groupBy(*_SPEED_KEY).agg(last).select(
        *_SPEED_KEY, F.col("s.end_rate").alias("ms_per_char"), F.col("s.end_samples").alias("samples"),
        F.timestamp_micros("s.last_us").alias("updated_at"))


def limit_s(chars: int, rate: float | None, warm: bool) -> float:
    """Seconds after which an attempt has run away."""
    expected = BASE_MS + max(chars, 0) * (DEFAULT_RATE_MS if rate is None else rate)
    return max(WARM_FLOOR_S, RUNAWAY_FACTOR * expected / 1000) if warm else COLD_LIMIT_S


_ATTEMPT_COLUMNS = [*_SPEED_KEY, "event_id", "ts", "chars", "duration_ms", "ok", "counted", "slice", "at_us", "x", "low", "high"]


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Label the attempts of every slice of a queue in order, from the state at its start."""
    key, states, success = None, {}, None
    columns = [*_SPEED_KEY, "slice", "at_us", "chars", "duration_ms", "ok", "x", "start_rate", "start_samples", "start_success"]
    for batch in batches:
        out = []
        for queue, engine, model, part, at, chars, took, ok, x, rate, seen, before in zip(*[batch[c].tolist() for c in columns]):
            if (queue, part) != key:
                key, states = (queue, part), {}
                success = None if pd.isna(before) else int(before)
            rate, seen = states.get((engine, model), (None if pd.isna(rate) else rate, seen))
            warm = success is not None and at - success < WARM_WINDOW_S * 1_000_000 and seen >= WARM_SAMPLES
            limit = limit_s(0 if pd.isna(chars) else chars, rate, warm)
            label = "runaway" if took / 1000 > limit else "ok" if ok else "fail"
            known = (success, rate, seen, warm, limit, label)
            if label == "ok":
                success = at
                if not pd.isna(x):
                    rate, seen = next_rate(rate, x), seen + 1
            states[engine, model] = (rate, seen)
            out.append((*known, rate, seen))
        told = _table(out, "success_us rate samples warm limit_s label rate_after samples_after").astype(
            {"success_us": "Int64", "rate": "Float64", "rate_after": "Float64"})
        told.index = batch.index
        yield pd.concat([batch[_ATTEMPT_COLUMNS], told], axis=1)


def latest_speed(labelled: DataFrame) -> DataFrame:
    """Current average per queue, engine and model, from labelled attempts: that after the last sample."""
    counted = (F.col("label") == "ok") & observed_rate().isNotNull()
    last = F.max_by(F.struct("rate_after", "samples_after", "ts"), F.struct("ts", "event_id")).alias("s")
    return labelled.filter(counted).groupBy(*_SPEED_KEY).agg(last).select(
        *_SPEED_KEY, F.col("s.rate_after").alias("ms_per_char"), F.col("s.samples_after").alias("samples"),
        F.col("s.ts").alias("updated_at"))


def estimate_ms(chars: Column, rate: Column, base: float = BASE_MS) -> Column:
    """Expected milliseconds; the default speed without a measurement."""
    return F.lit(base) + F.greatest(chars, F.lit(0)) * F.coalesce(rate, F.lit(DEFAULT_RATE_MS))


def estimates(work: DataFrame, states: DataFrame) -> DataFrame:
    """Estimate for `(queue, engine, model, chars, versions)`, several versions taking as many times as long."""
    return work.join(states.select(*_SPEED_KEY, "ms_per_char"), _SPEED_KEY, "left").withColumn(
        "estimate_ms", estimate_ms(F.col("chars"), F.col("ms_per_char")) * F.col("versions")).drop("ms_per_char")


def speed_or_latest(wanted: DataFrame, states: DataFrame) -> DataFrame:
    """The wanted entry's speed; without one, its queue's most recently updated entry; without any, the default."""
    latest = states.groupBy("queue").agg(
        F.max_by("ms_per_char", F.struct("updated_at", "engine", "model")).alias("__latest"))
    known = wanted.join(states.select(*_SPEED_KEY, "ms_per_char"), _SPEED_KEY, "left").join(latest, "queue", "left")
    return known.withColumn("ms_per_char", F.coalesce("ms_per_char", "__latest", F.lit(DEFAULT_RATE_MS))).drop("__latest")


def _relabelled(rows: DataFrame) -> DataFrame:
    """Label every slice by itself, from the state that the attempts that are `counted` leave before it."""
    counts = F.col("counted")
    starts = _chained(rows.withColumn("observed", F.when(counts, F.col("x")))).select(
        *_SPEED_KEY, "slice", "start_rate", "start_samples")
    so_far = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    successes = rows.groupBy("queue", "slice").agg(F.max(F.when(counts, F.col("at_us"))).alias("__last")).select(
        "queue", "slice", F.max("__last").over(so_far).alias("start_success"))
    placed = rows.join(starts, [*_SPEED_KEY, "slice"]).join(successes, ["queue", "slice"])
    return _walk(placed, ["queue", "slice"], ["at_us", "event_id"], _label,
                 "queue string, engine string, model string, event_id bigint, ts timestamp, chars bigint, duration_ms double, "
                 "ok boolean, counted boolean, slice bigint, at_us bigint, x double, low double, high double, "
                 "success_us bigint, rate double, samples bigint, warm boolean, limit_s double, label string, "
                 "rate_after double, samples_after bigint")


def label_attempts(attempts: DataFrame, seconds: int = SLICE_S) -> DataFrame:
    """Label each attempt `ok`, `fail` or `runaway`, with the limit, the average, its sample count and the queue's last
    success that applied to it, and with the average and sample count after it.

    Only attempts labelled `ok` are samples of the speed average and successes of the queue, so labels depend on earlier
    labels.  They are found by rounds: guess which attempts count; find the state at the start of every slice of time from
    that, by step functions; label each slice in order from there; take the labels as the next guess until none changes.
    A round makes the first slice that has a wrong label right, so the rounds end at the one labelling in order.  Two or
    three are usual, as a slice forgets what came before it.  Every round is written to the shared folder.
    """
    took = F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0))
    ok = F.coalesce("ok", F.lit(False))
    rows = attempts.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _SPEED_KEY], "event_id",
        F.col("ts").cast("timestamp").alias("ts"), F.col("chars").cast("bigint").alias("chars"), took.alias("duration_ms"),
        ok.alias("ok"), (ok & (took <= COLD_LIMIT_S * 1000)).alias("counted"))
    rows = written(_with_bounds(_slices(rows, seconds)).withColumnRenamed("observed", "x"), "attempts")
    while True:
        found = written(_relabelled(rows), "labels")
        now = F.col("label") == "ok"
        if found.filter(now != F.col("counted")).isEmpty():
            return found.withColumn("last_success_at", F.timestamp_micros("success_us")).drop(
                "counted", "slice", "at_us", "x", "low", "high", "success_us")
        rows = found.withColumn("counted", now).select(_ATTEMPT_COLUMNS)


# ---------------------------------------------------------------- progress


def progress_percent() -> Column:
    """Percent done between 0 and 100; 0 while the total is unknown."""
    return F.when(F.col("total") > 0, F.least(F.lit(100.0), F.greatest(
        F.lit(0.0), F.col("current") / F.col("total") * 100))).otherwise(F.lit(0.0))


#: A run of updates is cut into slices of this many milliseconds; a slice also looks at the rows just behind it, in which
#: the update sent after its last one must be.
RUN_SLICE_MS = 60_000
_BEHIND_MS = 2 * THROTTLE_MS


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep the updates to send; rows arrive ordered by slice and time, the slice's entry, if it is told, first."""
    part, entry, sent_at, sent_pct = None, None, None, 0.0
    for batch in batches:
        keep = []
        for key, run, number, told, opening, event, at, pct in zip(*[batch[c].tolist() for c in (
                "key", "__run", "__slice", "__entry", "__opening", "event_id", "at_ms", "progress")]):
            if (key, run, number) != part:
                part, entry, sent_at = (key, run, number), (at, event) if told or opening else None, None
            if sent_at is None:
                send = not told and (at, event) == entry
            else:
                send = at - sent_at >= THROTTLE_MS or abs(pct - sent_pct) >= THROTTLE_POINTS
            if send:
                sent_at, sent_pct = at, pct
            keep.append(send)
        yield batch.loc[keep, ["key", "event_id", "at_ms", "progress", "status"]]


_LINK = "key __run from_at from_event to_at to_event"


def _entries_after(slice_ms: int):
    """Links of one slice: if its first update sent is this one, the first sent behind the slice is that one.

    Any row up to half a second into the slice may be its first update sent; in the opening slice of a run only the
    run's first row can be.
    """
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_ms", "event_id"], ignore_index=True)
        at, pct, event = (rows[c].to_numpy() for c in ("at_ms", "progress", "event_id"))
        n = int(rows["__home"].sum())  # rows behind the slice come last
        if n == 0 or n == len(rows):
            return pd.DataFrame({c: pd.Series(dtype="str" if c == "key" else "int64") for c in _LINK.split()})
        beyond = np.searchsorted(at, at + THROTTLE_MS)
        entries = 1
        if not rows["__opening"].iloc[0]:
            entries = min(n, int(np.searchsorted(at, at[0] // slice_ms * slice_ms + THROTTLE_MS)) + 1)
        leads = np.full(n, -2)  # the row behind the slice to which a row leads; -1: none, -2: not known yet

        def after(i: int) -> int:
            moved = np.abs(pct[i + 1:beyond[i]] - pct[i]) >= THROTTLE_POINTS
            return i + 1 + int(moved.argmax()) if moved.any() else int(beyond[i])

        for start in range(entries):
            chain, i = [], start
            while i < n and leads[i] == -2:
                chain.append(i)
                i = after(i)
            leads[chain] = leads[i] if i < n else i if i < len(rows) else -1
        linked = np.flatnonzero(leads[:entries] >= 0)
        to = leads[linked]
        return pd.DataFrame({"key": rows["key"].iloc[0], "__run": rows["__run"].iloc[0], "from_at": at[linked],
                             "from_event": event[linked], "to_at": at[to], "to_event": event[to]})

    return links


def _entries(rows: DataFrame, slice_ms: int) -> DataFrame:
    """The first update sent in every slice of a run but its opening one, by pointer doubling.

    A slice's links lead from its possible entries into a later slice.  Links of 1, 2, 4 ... steps are joined from each
    other; from the runs' first rows, the longest links first, they reach all entries.
    """
    long = rows.filter("NOT __opening").select("key", "__run").distinct()
    inside = rows.join(long, ["key", "__run"], "left_semi")
    near = (F.pmod("at_ms", F.lit(slice_ms)) < _BEHIND_MS) & ~F.col("__opening")
    places = F.array(F.struct(F.col("__slice").alias("s"), F.lit(True).alias("h")), F.when(
        near, F.struct((F.col("__slice") - 1).alias("s"), F.lit(False).alias("h"))))
    shown = inside.withColumn("__place", F.explode(F.array_compact(places))).withColumn("__home", F.col("__place.h")).withColumn(
        "__opening", F.floor(F.col("__opened") / slice_ms) == F.col("__place.s")).withColumn("__slice", F.col("__place.s"))
    schema = ", ".join(f"{c} {'string' if c == 'key' else 'bigint'}" for c in _LINK.split())
    links = written(shown.select("key", "__run", "__slice", "__home", "__opening", "event_id", "at_ms", "progress").groupBy(
        "key", "__run", "__slice").applyInPandas(_entries_after(slice_ms), schema), "links")
    reached = inside.filter("__first").select(
        "key", "__run", F.col("at_ms").alias("at"), F.col("event_id").alias("event"), F.lit(True).alias("start"))
    levels = []
    while not links.isEmpty():
        levels.append(links)
        a, b = links.alias("a"), links.alias("b")
        links = written(a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.__run") == F.col("b.__run")) & (
            F.col("a.to_at") == F.col("b.from_at")) & (F.col("a.to_event") == F.col("b.from_event"))).select(
            "a.key", "a.__run", "a.from_at", "a.from_event", "b.to_at", "b.to_event"), "links")
    for links in reversed(levels):
        l = links.withColumnsRenamed({"from_at": "at", "from_event": "event"})
        reached = written(reached.unionByName(reached.join(l, ["key", "__run", "at", "event"]).select(
            "key", "__run", F.col("to_at").alias("at"), F.col("to_event").alias("event"), F.lit(False).alias("start"))), "entries")
    return reached.filter("NOT start").drop("start")


def throttled_progress(updates: DataFrame, block_ms: int = 3_600_000, slice_ms: int = RUN_SLICE_MS) -> DataFrame:
    """Updates that are passed on to listeners.

    An update goes out when it ends the work, half a second after the last one
    sent, or when progress moved by a point since then.  After a pause of half
    a second an update is always sent, whatever was sent before, so such rows
    open independent runs.  A run without a pause is cut into slices; which
    update is the first one sent in a slice follows from the links between
    slices (`_entries`), and then each slice is walked on its own, as a stream.
    Rows of a key need different (at_ms, event_id); a slice must be two seconds or longer.
    """
    rows = updates.withColumn("progress", progress_percent()).withColumn(
        "__forced", F.coalesce(F.col("status").isin("complete", "error"), F.lit(False)))
    block = F.floor(F.col("at_ms") / block_ms).cast("bigint")
    opens = lambda before, now: (
        before.isNull() | (now["at"] - before["v"]["at"] >= THROTTLE_MS) | now["forced"])
    value = F.struct(F.col("at_ms").alias("at"), F.col("__forced").alias("forced"))
    start = F.struct(F.col("at_ms").alias("at"), F.col("event_id").alias("event"))
    rows = ordered_scan(rows, ["key"], ["at_ms", "event_id"], block, [
        running_steps(value, lambda before, now: opens(before, now).cast("bigint"), "__run"),
        kept_since(value, opens, start, "__start")])
    number = lambda at: F.floor(at / slice_ms).cast("bigint")
    rows = written(rows.select(
        "key", "__run", "event_id", "at_ms", "progress", "status", F.col("__start.at").alias("__opened"),
        ((F.col("__start.at") == F.col("at_ms")) & (F.col("__start.event") == F.col("event_id"))).alias("__first"),
        number(F.col("at_ms")).alias("__slice"), (number(F.col("at_ms")) == number(F.col("__start.at"))).alias("__opening")), "runs")
    told = _entries(rows, slice_ms).select(
        "key", "__run", F.col("event").alias("event_id"), F.col("at").alias("at_ms"), F.lit(0.0).alias("progress"),
        F.lit(None).cast("string").alias("status"), number(F.col("at")).alias("__slice"), F.lit(False).alias("__opening"),
        F.lit(True).alias("__entry"))
    spread = rows.drop("__first", "__opened").withColumn("__entry", F.lit(False)).unionByName(told).repartition(
        "key", "__run", "__slice").sortWithinPartitions("key", "__run", "__slice", F.desc("__entry"), "at_ms", "event_id")
    schema = "key string, event_id bigint, at_ms bigint, progress double, status string"
    return spread.mapInPandas(_emit, schema)


def latest_progress(updates: DataFrame) -> DataFrame:
    """Latest state per key and whether it is still active."""
    last = F.max_by(F.struct("status", progress_percent().alias("progress")), F.struct("at_ms", "event_id")).alias("s")
    return updates.groupBy("key").agg(last).select("key", "s.*").withColumn(
        "active", F.col("status").isin("downloading", "extracting"))


# ---------------------------------------------------------------- lifecycle and files


def fail_stale(generations: DataFrame) -> DataFrame:
    """Work that was still running at start-up has failed."""
    stale = F.col("status").isin("generating", "loading_model")
    return generations.withColumn("error", F.when(stale, STALE_MESSAGE)).withColumn(
        "status", F.when(stale, "failed").otherwise(F.col("status")))


def latest_status(changes: DataFrame) -> DataFrame:
    """Status after the last change of each id."""
    return changes.groupBy("id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("changed_at"),
        F.count("*").alias("changes"))


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files `(path, mtime)` that are new or have another modification time."""
    return listing.join(known, ["path", "mtime"], "left_anti")


#: How a log line names the attempt and the best score.
_ATTEMPT = r"[Tt]entative\s+(\d+)\s*/"
_BEST = r"(?i)meilleur\s*:\s*(\d+|—|-)"


def told_metrics() -> list[Column]:
    """What one log line tells: `attempt`, `best` (null for a dash), and whether it has a best score at all."""
    best = F.regexp_extract("line", _BEST, 1)
    return [F.regexp_extract("line", _ATTEMPT, 1).try_cast("int").alias("attempt"), best.try_cast("int").alias("best"),
            F.coalesce(best != "", F.lit(False)).alias("told")]


def log_metrics(log: DataFrame, seconds: int = SLICE_S) -> DataFrame:
    """Attempt number and best percent after every log line.

    Attempt 1 opens a new series and clears the best; a dash means none yet.
    """
    attempt, best, told = told_metrics()
    rows = log.withColumns({"__a": attempt, "__b": best, "__t": told})
    block, order = time_block(F.col("ts"), seconds), ["ts", "event_id"]
    known = F.when(F.col("__t"), F.struct(F.col("__b").alias("v"))).when(
        F.col("__a") == 1, F.struct(F.lit(None).cast("int").alias("v")))
    return ordered_scan(
        rows, ["queue"], order, block,
        [running_sum((F.coalesce("__a", F.lit(0)) == 1).cast("bigint"), "series"),
         last_known(F.col("__a"), "attempt"), last_known(known, "__best")],
    ).withColumn("best_percent", F.col("__best.v")).drop("__a", "__b", "__t", "__best")
