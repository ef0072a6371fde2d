"""Ordered state, batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ordered as od
from lectern.operators import state as st
from lectern.plans.domain import ctes
from lectern.plans.registry import query

# One queue is walked in order; averages and counts of its engines and models are lists.  printf rounds the exact binary
# value, as the average itself does; round() would scale first.
_WALK = ctes("speed_samples").replace("WITH", "WITH RECURSIVE", 1) + """
, o AS (SELECT *, dense_rank() OVER (ORDER BY engine, model) AS k, row_number() OVER (PARTITION BY queue ORDER BY ts, event_id)
  AS i, CASE WHEN chars > 0 AND duration_ms > 0 THEN greatest(duration_ms - 500, 0) / chars END AS x FROM speed_samples),
walk AS (SELECT queue, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS before,
    CAST(NULL AS BOOLEAN) AS warm, CAST(NULL AS DOUBLE) AS limit_s, CAST(NULL AS VARCHAR) AS label,
    [CAST(NULL AS DOUBLE) FOR n IN range(max(k))] AS rates, [CAST(0 AS BIGINT) FOR n IN range(max(k))] AS counts,
    CAST(NULL AS TIMESTAMP) AS success FROM o GROUP BY queue UNION ALL
  SELECT queue, i, event_id, success, warm, limit_s, label,
    CASE WHEN label = 'ok' AND x IS NOT NULL THEN rates[:k - 1] || [CAST(printf('%.3f', CASE WHEN rates[k] IS NULL THEN x
      ELSE 0.3::DOUBLE * x + 0.7::DOUBLE * rates[k] END) AS DOUBLE)] || rates[k + 1:] ELSE rates END,
    CASE WHEN label = 'ok' AND x IS NOT NULL THEN counts[:k - 1] || [counts[k] + 1] || counts[k + 1:] ELSE counts END,
    CASE WHEN label = 'ok' THEN ts ELSE success END FROM (
      SELECT *, CASE WHEN duration_ms / 1000 > limit_s THEN 'runaway' WHEN ok THEN 'ok' ELSE 'fail' END AS label FROM (
        SELECT *, CASE WHEN warm THEN greatest(25, 3 * (500 + chars * coalesce(rates[k], 80)) / 1000) ELSE 300 END AS limit_s
        FROM (SELECT o.*, w.rates, w.counts, w.success,
            coalesce(date_diff('microsecond', w.success, o.ts) / 1e6 < 600 AND w.counts[o.k] >= 3, false) AS warm
          FROM walk w JOIN o ON o.queue = w.queue AND o.i = w.i + 1))))"""
_FINAL = _WALK + """, fin AS (SELECT queue, engine, model, w.rates[k] AS ms_per_char, w.counts[k] AS samples, ts AS updated_at
  FROM walk w JOIN o USING (queue, i) WHERE w.label = 'ok' AND x IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY queue, engine, model ORDER BY i DESC) = 1)"""


def _average(t):
    return st.latest_speed(st.label_attempts(t.speed_samples))


@query("speed_average", _FINAL + "SELECT queue, engine, model, ms_per_char, samples, updated_at FROM fin")
def _(t):
    return _average(t).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


_WORK = ["event_id", "concat('server-', user_id % 2) AS queue",
         "CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS engine",
         "CASE WHEN event_id % 2 = 0 THEN '0.6B' ELSE '1.7B' END AS model", "event_id % 90 AS chars",
         "1 + event_id % 2 AS versions"]


@query("generation_estimate", _FINAL + f"""
SELECT w.event_id, (500 + w.chars * coalesce(f.ms_per_char, 80)) * w.versions AS estimate_ms
FROM (SELECT {", ".join(_WORK)} FROM events) w LEFT JOIN fin f USING (queue, engine, model)""")
def _(t):
    return st.estimates(t.events.selectExpr(*_WORK), _average(t)).select("event_id", "estimate_ms")


_WANTED = """SELECT concat('server-', user_id % 3) AS queue, event_type AS engine, '1.7B' AS model FROM events UNION
SELECT concat('server-', user_id % 3) AS queue, concat(event_type, '-x') AS engine, '1.7B' AS model FROM events"""


@query("speed_or_latest_entry", _FINAL + f"""
SELECT w.queue, w.engine, coalesce(f.ms_per_char, l.latest, 80) AS ms_per_char FROM ({_WANTED}) w
LEFT JOIN fin f USING (queue, engine, model)
LEFT JOIN (SELECT queue, arg_max(ms_per_char, (updated_at, engine, model)) AS latest FROM fin GROUP BY queue) l USING (queue)""")
def _(t):
    e = t.events.selectExpr("concat('server-', user_id % 3) AS queue", "event_type AS engine", "'1.7B' AS model").distinct()
    wanted = e.union(e.withColumn("engine", F.concat("engine", F.lit("-x"))))
    return st.speed_or_latest(wanted, _average(t)).select("queue", "engine", "ms_per_char")


@query("last_success_as_of", _WALK + """
SELECT event_id, queue, before AS last_success_at FROM walk WHERE i > 0""")
def _(t):
    return st.label_attempts(t.speed_samples).select(
        "event_id", "queue", F.col("last_success_at").cast("timestamp_ntz").alias("last_success_at"))


@query("runaway_labels", _WALK + """
SELECT event_id, warm, round(limit_s, 6) AS limit_s, label FROM walk WHERE i > 0""")
def _(t):
    return st.label_attempts(t.speed_samples).select("event_id", "warm", F.round("limit_s", 6).alias("limit_s"), "label")


@query("throttled_progress", ctes("progress").replace("WITH", "WITH RECURSIVE", 1) + """
, p AS (SELECT *, CASE WHEN total > 0 THEN least(100, greatest(0, current / total * 100)) ELSE 0 END AS pct,
  row_number() OVER (PARTITION BY key ORDER BY at_ms, event_id) AS i FROM progress),
w AS (SELECT key, i, event_id, at_ms, pct, status, true AS sent, at_ms AS last_at, pct AS last_pct FROM p WHERE i = 1
  UNION ALL SELECT key, i, event_id, at_ms, pct, status, s, CASE WHEN s THEN at_ms ELSE last_at END,
  CASE WHEN s THEN pct ELSE last_pct END FROM (SELECT p.*, w.last_at, w.last_pct, p.status IN ('complete', 'error')
    OR p.at_ms - w.last_at >= 500 OR abs(p.pct - w.last_pct) >= 1.0 AS s
    FROM w JOIN p ON p.key = w.key AND p.i = w.i + 1))
SELECT key, event_id, at_ms, CAST(pct AS DOUBLE) AS progress, status FROM w WHERE sent""")
def _(t):
    return st.throttled_progress(t.progress)


@query("latest_progress", ctes("progress") + """
SELECT key, status, CAST(CASE WHEN total > 0 THEN least(100, greatest(0, current / total * 100)) ELSE 0 END AS DOUBLE)
  AS progress, status IN ('downloading', 'extracting') AS active FROM progress
QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_ms DESC, event_id DESC) = 1""")
def _(t):
    return st.latest_progress(t.progress)


@query("stale_work_sweep", ctes("generations") + f"""
SELECT id, CASE WHEN status = 'generating' THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'generating' THEN '{st.STALE_MESSAGE}' END AS error FROM generations""")
def _(t):
    return st.fail_stale(t.generations).select("id", "status", "error")


_CHANGES = """SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'signup' THEN 'loading_model' WHEN 'click' THEN
'generating' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events"""


@query("status_lifecycle", f"""WITH c AS ({_CHANGES})
SELECT id, arg_max(status, (ts, event_id)) AS status, max(ts) AS changed_at, count(*) AS changes FROM c GROUP BY 1""")
def _(t):
    return st.latest_status(t.events.selectExpr(
        "user_id AS id", "ts", "event_id", "CASE event_type WHEN 'signup' THEN 'loading_model' WHEN 'click' THEN "
        "'generating' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status"))


@query("changed_files", """
SELECT l_orderkey AS path, l_shipdate AS mtime FROM lineitem WHERE (l_orderkey, l_shipdate) NOT IN
(SELECT (l_orderkey, l_shipdate) FROM lineitem WHERE l_returnflag <> 'N')""")
def _(t):
    files = t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_shipdate").alias("mtime"), "l_returnflag")
    return st.changed_files(files.drop("l_returnflag"), files.filter("l_returnflag <> 'N'").drop("l_returnflag"))


@query("log_metrics", ctes("log_lines") + """
, m AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '[Tt]entative\\s+(\\d+)\\s*/', 1), '') AS INT) AS a,
  nullif(regexp_extract(line, '(?i)meilleur\\s*:\\s*(\\d+|—|-)', 1), '') AS b FROM log_lines),
s AS (SELECT *, sum(CASE WHEN a = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY ts, event_id) AS series FROM m)
SELECT queue, event_id, CAST(series AS BIGINT) AS series,
  last_value(a IGNORE NULLS) OVER (PARTITION BY queue ORDER BY ts, event_id) AS attempt,
  TRY_CAST(last_value(b IGNORE NULLS) OVER (PARTITION BY queue, series ORDER BY ts, event_id) AS INT) AS best_percent
FROM s""")
def _(t):
    return st.log_metrics(t.log_lines).select("queue", "event_id", "series", "attempt", "best_percent")


@query("merged_event_runs", """
WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM f)
SELECT user_id, CAST(run_no AS BIGINT) AS run_no, event_type AS run_value, count(*) AS events, min(ts) AS first_at,
  max(ts) AS last_at FROM g GROUP BY 1, 2, 3""")
def _(t):
    return od.merged_runs(
        t.events, ["user_id"], ["ts", "event_id"], od.time_block(F.col("ts"), 86400), F.col("event_type"),
        {"events": F.count("*"), "first_at": F.min("ts"), "last_at": F.max("ts")})


@query("two_sided_fill", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS before, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events""")
def _(t):
    known = F.when(F.col("event_type") == "purchase", F.col("value"))
    return od.ordered_scan(
        t.events, ["user_id"], ["ts", "event_id"], od.time_block(F.col("ts"), 86400),
        [od.last_known(known, "before"), od.next_known_after(known, "after")]).select("event_id", "before", "after")
