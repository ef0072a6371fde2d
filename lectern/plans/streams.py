"""Streaming jobs run to the end of the given events, checked against the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import state as st
from lectern.plans import state as batch
from lectern.plans.domain import VIEWS
from lectern.plans.registry import ORACLES, query
from lectern.streaming import jobs
from lectern.streaming.runner import drain, latest_per_key, open_stream


def _events(t):
    return open_stream(t.spark, t.sf_dir, "events.parquet")


def _view(t, name: str):
    return _events(t).selectExpr(*VIEWS[name][1])


@query("stream_client_last_seen", ORACLES["client_last_seen"])
def _(t):
    return latest_per_key(drain(jobs.last_seen(_view(t, "requests")), "update"), ["client_id"])


@query("stream_latest_progress", ORACLES["latest_progress"])
def _(t):
    return latest_per_key(drain(jobs.latest_progress(_view(t, "progress")), "update"), ["key"])


@query("stream_throttled_progress", ORACLES["throttled_progress"])
def _(t):
    return drain(jobs.throttled_progress(_view(t, "progress")), "append").drop("batch_id")


@query("stream_runaway_labels", ORACLES["runaway_labels"])
def _(t):
    labelled = drain(jobs.label_attempts(_view(t, "speed_samples")), "append", empty_batches=False)
    return labelled.select("event_id", "warm", F.round("limit_s", 6).alias("limit_s"), "label")


@query("stream_labels_after_batch", ORACLES["runaway_labels"])
def _(t):
    """The first part of the month in a batch, the rest as a stream that starts from the batch's state."""
    early = F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")
    first = st.label_attempts(t.speed_samples.filter(early))
    rest = jobs.label_attempts(_view(t, "speed_samples").filter(~early), jobs.batch_states(first))
    columns = ["event_id", "warm", F.round("limit_s", 6).alias("limit_s"), "label"]
    return first.select(*columns).unionByName(drain(rest, "append", empty_batches=False).select(*columns))


@query("stream_speed_average", batch._FINAL + "SELECT queue, engine, model, ms_per_char, samples FROM fin")
def _(t):
    labelled = drain(jobs.label_attempts(_view(t, "speed_samples")), "append", empty_batches=False).filter("samples > 0")
    last = F.max_by("ms_per_char", F.struct("samples", "event_id")).alias("ms_per_char")
    return labelled.groupBy("queue", "engine", "model").agg(last, F.max("samples").alias("samples"))


@query("stream_speak_intervals", """
SELECT a.event_id AS id, a.ts AS started_at, b.ts AS ended_at, epoch_us(b.ts) - epoch_us(a.ts) AS spoken_us
FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_id % 2 = 0 AND b.ts >= a.ts
AND b.ts <= a.ts + INTERVAL 10 MINUTE""")
def _(t):
    starts = _events(t).filter("event_id % 2 = 0").selectExpr("event_id AS id", "ts")
    ends = _events(t).filter("event_id % 2 = 1").selectExpr("event_id - 1 AS id", "ts")
    pairs = drain(jobs.speak_intervals(starts, ends), "append").drop("batch_id")
    return pairs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


_STATUS = ("CASE event_type WHEN 'signup' THEN 'loading_model' WHEN 'click' THEN 'generating' WHEN 'error' THEN 'failed' "
           "ELSE 'completed' END AS status")


def _stale_work(t):
    changes = _events(t).selectExpr("user_id AS id", "ts", "event_id", _STATUS)
    return drain(jobs.stale_work(changes, timeout_ms=3_600_000), "append").drop("batch_id")


@query("stream_stale_work")
def _(t):
    return _stale_work(t)


@query("stream_stale_changes", f"SELECT user_id AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms, {_STATUS} FROM events")
def _(t):
    return _stale_work(t).filter("error IS NULL").select("id", "at_ms", "status")


@query("stream_log_metrics", ORACLES["log_metrics"])
def _(t):
    return drain(jobs.log_metrics(_view(t, "log_lines")), "append", empty_batches=False).drop("batch_id")
