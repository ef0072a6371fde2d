"""Streaming forms of the ordered-state operators.

Keyed jobs hold a few numbers per key.  Spark sorts the rows of a micro-batch
by key and time below the keyed operator, and they stream through it in pieces:
however many rows a key brings at once, Python holds one piece.  Spark's check
of streaming plans knows no sort inside a micro-batch, so these jobs are started
by `runner.drain`, or with `spark.sql.streaming.unsupportedOperationCheck` off.

How state ends: labels and log metrics keep it for a time to live after its
last change, utterances and stale work until the watermark (ten minutes by
default) has passed it.  Progress and last-seen keep one small row per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import state as st
from lectern.session import scratch_path
from lectern.streaming.runner import open_stream

WATERMARK = "10 minutes"


def last_seen(requests: DataFrame) -> DataFrame:
    """Latest request time per client, tracked paths only; update mode."""
    from lectern.operators.library import last_seen as batch_last_seen

    return batch_last_seen(requests)


def latest_progress(updates: DataFrame) -> DataFrame:
    """Latest state per key; update mode."""
    return st.latest_progress(updates)


def _in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of each micro-batch where their key's state is, by key and `order`; the keyed operator adds no sort.

    No number of tasks is given: the stream takes that of its checkpoint, as the state does.
    """
    return rows.repartition(key).sortWithinPartitions(key, *order)


#: How long the state of a queue is kept after its last change.
STATE_TTL_MS = 30 * 24 * 3_600_000


class AttemptLabels(StatefulProcessor):
    """Labels one queue's attempts in order: the averages of its engines and models, and its last success."""

    def __init__(self, ttl_ms: int, started: bool = False):
        self.ttl_ms, self.started = ttl_ms, started

    def init(self, handle) -> None:
        self.speeds = handle.getMapState("speeds", "engine string, model string", "rate double, seen bigint", self.ttl_ms)
        self.success = handle.getValueState("success", "at_us bigint", self.ttl_ms)
        if self.started:
            self.begun = handle.getValueState("begun", "begun boolean")

    def _begin(self, piece: pd.DataFrame, new: bool, known: dict, changed: set) -> pd.DataFrame:
        """The attempts of a piece.  Rows of the state before them come first; a queue that is not new has its own."""
        attempt = piece["attempt"].astype(bool)
        for row in piece[~attempt].itertuples(index=False) if new else ():
            if row.samples > 0:
                known[row.engine, row.model] = (float(row.ms_per_char), int(row.samples))
                changed.add((row.engine, row.model))
            if not pd.isna(row.success_us):
                self.success_us = int(row.success_us)
        return piece[attempt]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        given = self.success.get()
        self.success_us = before = given[0] if given else None
        known, changed = {}, set()
        new = self.started and self.begun.get() is None
        for piece in rows:
            if self.started:
                piece = self._begin(piece, new, known, changed)
            if len(piece):
                yield self._labelled(key, piece, known, changed)
        for own in changed:
            self.speeds.updateValue(own, known[own])
        if self.success_us != before:
            self.success.update((self.success_us,))
        if new:
            self.begun.update((True,))

    def _labelled(self, key, piece: pd.DataFrame, known: dict, changed: set) -> pd.DataFrame:
        success_us, out = self.success_us, []
        for row in piece.itertuples(index=False):
            own = (row.engine, row.model)
            if own not in known:
                known[own] = self.speeds.getValue(own) if self.speeds.containsKey(own) else (None, 0)
            rate, seen = known[own]
            warm = success_us is not None and row.at_us - success_us < st.WARM_WINDOW_S * 1_000_000 and (
                seen >= st.WARM_SAMPLES)
            limit = st.limit_s(row.chars, rate, warm)
            label = "runaway" if row.duration_ms / 1000 > limit else "ok" if row.ok else "fail"
            if label == "ok":
                success_us = int(row.at_us)
                if row.chars > 0 and row.duration_ms > 0:
                    rate, seen = st.next_rate(rate, max(row.duration_ms - st.BASE_MS, 0.0) / row.chars), seen + 1
                    known[own] = (rate, seen)
                    changed.add(own)
            out.append((key[0], *own, row.event_id, warm, limit, label, rate, seen, success_us))
        self.success_us = success_us
        return pd.DataFrame(out, columns=_LABELS.split()).astype({"ms_per_char": "Float64", "success_us": "Int64"})

    def close(self) -> None:
        pass


_LABELS = "queue engine model event_id warm limit_s label ms_per_char samples success_us"
_LABEL_TYPES = ("queue string, engine string, model string, event_id bigint, warm boolean, limit_s double, label string, "
                "ms_per_char double, samples bigint, success_us bigint")


def batch_states(labelled: DataFrame) -> DataFrame:
    """What a stream needs to go on from attempts that were labelled in a batch: averages and last successes.

    A queue without a success in the batch has no row.
    """
    done = labelled.filter("label = 'ok'")
    successes = done.groupBy("queue").agg(F.max(F.unix_micros("ts")).alias("success_us"))
    return successes.join(st.speed_average(done), "queue", "left").select(
        "queue", "engine", "model", "ms_per_char", F.coalesce("samples", F.lit(0)).cast("bigint").alias("samples"), "success_us")


def _states_as_rows(states: DataFrame, folder: str | None) -> DataFrame:
    """States (see `batch_states`) as a stream of rows beside the attempts, all of them in its first micro-batch.

    Spark's own way to give a stream its first state keeps all rows of a key in Python until the state is read.
    """
    path = folder or scratch_path(states.sparkSession, "stream-start")
    states.write.mode("append").parquet(path)  # a checkpoint may name the files that are there
    return open_stream(states.sparkSession, path, files_per_batch=2**31 - 1).select(
        *[F.col(c).cast("string").alias(c) for c in ("queue", "engine", "model")], "ms_per_char", "samples", "success_us",
        F.lit(False).alias("attempt"))


def label_attempts(attempts: DataFrame, started_from: DataFrame | None = None, ttl_ms: int = STATE_TTL_MS,
                   start_folder: str | None = None) -> DataFrame:
    """Each attempt with its label, its limit, and the state after it; append mode.

    `started_from` (see `batch_states`) is the state before the first attempt of the stream, kept in `start_folder`.  A stream
    that goes on from a checkpoint needs both again; queues already seen keep their own state.  Averages and successes that
    nothing changed for `ttl_ms` are forgotten.  A queue is labelled in order by one task, as its state demands.
    """
    rows = attempts.select(
        *[F.col(c).cast("string").alias(c) for c in ("queue", "engine", "model")], "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "chars", "duration_ms", "ok")
    order = ["at_us", "event_id"]
    if started_from is not None:
        blank = {c: F.lit(0) for c in ("event_id", "at_us", "chars", "duration_ms")}  # no nulls: integers stay integers
        known = {c: F.lit(None).cast(kind) for c, kind in (
            ("ms_per_char", "double"), ("samples", "bigint"), ("success_us", "bigint"))}
        states = _states_as_rows(started_from, start_folder).withColumns({**blank, "ok": F.lit(False)})
        rows, order = rows.withColumns({**known, "attempt": F.lit(True)}).unionByName(states), ["attempt", *order]
    return _in_order(rows, "queue", *order).groupBy("queue").transformWithStateInPandas(
        AttemptLabels(ttl_ms, started_from is not None), _LABEL_TYPES, "Append", "ProcessingTime")


class LogMetrics(StatefulProcessor):
    """Series, attempt and best score of one queue's log."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "series bigint, attempt int, best int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        series, attempt, best = self.now.get() or (0, None, None)
        for lines in rows:
            out = []
            for event, told_attempt, told_best, told in zip(*[lines[c].tolist() for c in ("event_id", "attempt", "best", "told")]):
                if not pd.isna(told_attempt):
                    attempt = int(told_attempt)
                    if attempt == 1:
                        series, best = series + 1, None
                if told:
                    best = None if pd.isna(told_best) else int(told_best)
                out.append((key[0], event, series, attempt, best))
            yield pd.DataFrame(out, columns=["queue", "event_id", "series", "attempt", "best_percent"]).astype(
                {"attempt": "Int32", "best_percent": "Int32"})
        self.now.update((series, attempt, best))

    def close(self) -> None:
        pass


def log_metrics(log: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Series, attempt number and best percent after every log line; append mode."""
    rows = log.select("queue", "event_id", F.col("ts").cast("timestamp").alias("ts"), *st.told_metrics())
    return _in_order(rows, "queue", "ts", "event_id").groupBy("queue").transformWithStateInPandas(
        LogMetrics(ttl_ms), "queue string, event_id bigint, series bigint, attempt int, best_percent int", "Append",
        "ProcessingTime")


def _throttle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sent_at, sent_pct = state.get if state.exists else (None, None)
    for rows in batches:
        keep = []
        for at, pct, status in zip(rows["at_ms"], rows["progress"], rows["status"]):
            send = (sent_at is None or status in ("complete", "error") or at - sent_at >= st.THROTTLE_MS
                    or abs(pct - sent_pct) >= st.THROTTLE_POINTS)
            if send:
                sent_at, sent_pct = int(at), float(pct)
            keep.append(send)
        yield rows.loc[keep, ["key", "event_id", "at_ms", "progress", "status"]]
    state.update((sent_at, sent_pct))


def throttled_progress(updates: DataFrame) -> DataFrame:
    """Updates that are passed on to listeners; append mode."""
    rows = updates.withColumn("progress", st.progress_percent()).select(
        "key", "event_id", "at_ms", "progress", "status")
    return _in_order(rows, "key", "at_ms", "event_id").groupBy("key").applyInPandasWithState(
        _throttle, "key string, event_id bigint, at_ms bigint, progress double, status string",
        "sent_at bigint, sent_pct double", "append", GroupStateTimeout.NoTimeout)


def speak_intervals(starts: DataFrame, ends: DataFrame, longest: str = "10 minutes",
                    watermark: str = WATERMARK) -> DataFrame:
    """Pair start and end events `(id, ts)` of one utterance; both watermarks bound the join state; append mode."""
    a = starts.select(F.col("id"), F.col("ts").cast("timestamp").alias("started_at")).withWatermark(
        "started_at", watermark)
    b = ends.select(F.col("id").alias("end_id"), F.col("ts").cast("timestamp").alias("ended_at")).withWatermark(
        "ended_at", watermark)
    within = (F.col("id") == F.col("end_id")) & (F.col("ended_at") >= F.col("started_at")) & (
        F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {longest}"))
    return a.join(b, within).select("id", "started_at", "ended_at", (
        F.unix_micros("ended_at") - F.unix_micros("started_at")).alias("spoken_us"))


RUNNING = ("generating", "loading_model")


def _expire(timeout_ms: int):
    """One row per change.  The newest change of a key is kept until it times out, so that an older one, arriving late,
    doesn't start the key's work again."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at_ms, _ = state.get
            state.remove()
            if status in RUNNING:
                yield pd.DataFrame({"id": [key[0]], "status": ["failed"], "at_ms": [at_ms], "error": [st.STALE_MESSAGE]})
            return
        newest = state.get if state.exists else None
        for rows in batches:
            at = rows.sort_values(["at_ms", "event_id"]).iloc[-1]
            found = (at["status"], int(at["at_ms"]), int(at["event_id"]))
            newest = found if newest is None or found[1:] > newest[1:] else newest
            yield pd.DataFrame({"id": rows["id"], "status": rows["status"], "at_ms": rows["at_ms"],
                                "error": pd.Series([None] * len(rows), dtype=object, index=rows.index)})
        state.update(newest)
        state.setTimeoutTimestamp(max(newest[1] + timeout_ms, state.getCurrentWatermarkMs() + 1))

    return run


def stale_work(changes: DataFrame, timeout_ms: int, watermark: str = WATERMARK) -> DataFrame:
    """Every change `(id, ts, event_id, status)` as it comes, and `failed` when running work stays silent; append mode."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = timed.withColumn("at_ms", F.unix_millis("ts"))
    return rows.groupBy("id").applyInPandasWithState(
        _expire(timeout_ms), "id bigint, status string, at_ms bigint, error string",
        "status string, at_ms bigint, event_id bigint", "append", GroupStateTimeout.EventTimeTimeout)


def file_increments(folder_stream: DataFrame) -> DataFrame:
    """Rows of files not read before, with path and time: the file source and its checkpoint keep the files seen.

    A file that changes under its old name counts as seen; `sources.projects.modified_since` finds those.
    """
    return folder_stream.select("*", F.col("_metadata.file_path").alias("file"),
                                F.col("_metadata.file_modification_time").alias("mtime"))
