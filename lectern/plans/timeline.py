"""Story timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import timeline as tl
from lectern.plans.domain import ctes
from lectern.plans.registry import query

_MS = "CAST(trunc(duration * 1000) AS BIGINT)"
_EFF = f"({_MS} - trim_start_ms - trim_end_ms)"


@query("sequential_start_times", ctes("items") + f"""
SELECT id, story_id, CAST(coalesce(sum(coalesce({_MS}, 0) + 200) OVER (PARTITION BY story_id ORDER BY position, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_time_ms FROM
(SELECT * REPLACE (CASE WHEN track = 2 THEN NULL ELSE duration END AS duration) FROM items)""")
def _(t):
    some_null = t.items.withColumn("duration", F.when(F.col("track") != 2, F.col("duration")))
    return tl.sequential_starts(some_null, ["position", "id"], "position").select("id", "story_id", "start_time_ms")


@query("reordered_start_times", ctes("items") + f"""
, w AS (SELECT story_id, id, row_number() OVER (PARTITION BY story_id ORDER BY start_time_ms DESC, id) AS ord
  FROM items WHERE NOT (story_id % 2 = 1 AND track = 0)),
ok AS (SELECT story_id FROM items GROUP BY 1 HAVING count(*) =
  (SELECT count(*) FROM w WHERE w.story_id = items.story_id))
SELECT w.id, w.story_id, CAST(coalesce(sum({_MS} + 100) OVER (PARTITION BY w.story_id ORDER BY w.ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_time_ms
FROM w JOIN items i ON i.id = w.id WHERE w.story_id IN (SELECT story_id FROM ok)""")
def _(t):
    from lectern.operators.ordered import row_numbers

    asked = t.items.filter("NOT (story_id % 2 = 1 AND track = 0)").withColumn("back", -F.col("start_time_ms"))
    wanted = row_numbers(asked, ["story_id"], ["back", "id"], F.floor(F.col("back") / 2000).cast("bigint"), "ord")
    return tl.reorder(t.items, wanted.select("story_id", "id", "ord"), gap_ms=100).select(
        "id", "story_id", "start_time_ms")


@query("append_position", ctes("items") + f"""
SELECT s.story_id, s.track, coalesce((SELECT max(start_time_ms + {_MS}) + 200 FROM items i
  WHERE i.story_id = s.story_id AND i.track = s.track), 0) AS next_start_ms
FROM (SELECT DISTINCT story_id, tr AS track FROM items, (SELECT unnest([0, 1, 7]) AS tr)) s""")
def _(t):
    targets = t.items.select("story_id").distinct().select(
        "story_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))).alias("track"))
    return tl.append_position(t.items, targets)


@query("timeline_length", ctes("items") + f"""
SELECT story_id, max(start_time_ms + {_EFF}) AS length_ms FROM items GROUP BY 1""")
def _(t):
    return tl.timeline_length(t.items)


@query("story_track_list", ctes("items") + """
SELECT DISTINCT story_id, track FROM (SELECT story_id, track FROM items
UNION ALL SELECT story_id, unnest([1, 0, -1, 5]) FROM items)""")
def _(t):
    return tl.track_list(t.items, defaults=[1, 0, -1], extra=[5])


@query("trim_validation", ctes("items") + f"""
SELECT id, trim_start_ms + trim_end_ms < {_MS} AS valid FROM
  (SELECT * REPLACE (trim_start_ms * 10 AS trim_start_ms) FROM items)""")
def _(t):
    return t.items.withColumn("trim_start_ms", F.col("trim_start_ms") * 10).select(
        "id", tl.trims_valid().alias("valid"))


@query("clip_split", ctes("items") + f"""
SELECT id, 'whole' AS part, start_time_ms, trim_start_ms, trim_end_ms, volume FROM items WHERE NOT 3000 < {_EFF}
UNION ALL SELECT id, 'left', start_time_ms, trim_start_ms, {_MS} - (trim_start_ms + 3000), volume
FROM items WHERE 3000 < {_EFF}
UNION ALL SELECT id, 'right', start_time_ms + 3000, trim_start_ms + 3000, trim_end_ms, volume
FROM items WHERE 3000 < {_EFF}""")
def _(t):
    return tl.split_clips(t.items, F.lit(3000)).select(
        "id", "part", "start_time_ms", "trim_start_ms", "trim_end_ms", "volume")


@query("clip_duplicate", ctes("items") + f"""
SELECT id, start_time_ms, volume FROM items UNION ALL
SELECT concat(id, '-copy'), start_time_ms + {_EFF} + 200, volume FROM items WHERE track = 1""")
def _(t):
    return tl.duplicate_clips(t.items, t.items.filter("track = 1")).select("id", "start_time_ms", "volume")


_MOVES = """, moves AS (SELECT l_suppkey AS story_id, l_orderkey + CASE WHEN l_suppkey % 4 = 0 AND l_partkey % 50 = 0
  THEN 100000000 ELSE 0 END AS generation_id, max(l_partkey) AS new_start_ms FROM lineitem GROUP BY 1, 2)"""


@query("batch_move", ctes("items") + _MOVES + """
, bad AS (SELECT DISTINCT story_id FROM moves m WHERE NOT EXISTS (SELECT 1 FROM items i
  WHERE i.story_id = m.story_id AND i.generation_id = m.generation_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY story_id, generation_id ORDER BY position DESC, id DESC) AS k FROM items)
SELECT r.id, coalesce(m.new_start_ms, r.start_time_ms) AS start_time_ms FROM r LEFT JOIN moves m
ON m.story_id = r.story_id AND m.generation_id = r.generation_id AND r.k = 1
AND m.story_id NOT IN (SELECT story_id FROM bad)""")
def _(t):
    gen = F.col("l_orderkey") + F.when((F.col("l_suppkey") % 4 == 0) & (F.col("l_partkey") % 50 == 0),
                                       100000000).otherwise(0)
    moves = t.lineitem.groupBy(F.col("l_suppkey").alias("story_id"), gen.alias("generation_id")).agg(
        F.max("l_partkey").alias("new_start_ms"))
    return tl.batch_move(t.items, moves).select("id", "start_time_ms")


@query("idempotent_story_add", ctes("items") + """
, w AS (SELECT DISTINCT l_suppkey AS story_id, l_orderkey + (l_partkey % 2) * 1000000 AS generation_id FROM lineitem),
f AS (SELECT story_id, generation_id, arg_min(id, (position, id)) AS have FROM items GROUP BY 1, 2)
SELECT w.*, f.have IS NULL AS created, coalesce(f.have, concat('new-', w.generation_id)) AS id
FROM w LEFT JOIN f USING (story_id, generation_id)""")
def _(t):
    wanted = t.lineitem.select(F.col("l_suppkey").alias("story_id"),
                               (F.col("l_orderkey") + (F.col("l_partkey") % 2) * 1000000).alias("generation_id"))
    return tl.add_generations(t.items, wanted)


@query("version_pin_check", ctes("items", "versions") + """
SELECT i.id, i.version_id FROM items i JOIN versions v ON v.id = i.version_id AND v.generation_id = i.generation_id""")
def _(t):
    pins = t.items.filter("version_id IS NOT NULL").select("id", "version_id")
    return tl.valid_pins(t.items, pins, t.versions)


@query("active_items_at_time", ctes("items") + f"""
, p AS (SELECT event_id, user_id % 100 AS story_id, (event_id * 7919) % 1000000 AS at_ms FROM events)
SELECT p.event_id, p.story_id, p.at_ms, i.id, i.start_time_ms FROM p JOIN items i ON i.story_id = p.story_id
AND i.start_time_ms <= p.at_ms AND p.at_ms < i.start_time_ms + {_EFF}""")
def _(t):
    probes = t.events.select("event_id", (F.col("user_id") % 100).alias("story_id"),
                             ((F.col("event_id") * 7919) % 1000000).alias("at_ms"))
    return tl.active_at(t.items, probes).select("event_id", "story_id", "at_ms", "id", "start_time_ms")
