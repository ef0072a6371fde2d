"""Signals.  Embedding arrays stand in for short clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.rows import numbered_rows
from lectern.operators import signals as sg
from lectern.plans.registry import query

_DBL = "list_transform(embedding, lambda z: CAST(z AS DOUBLE))"
_NORM = ("list_transform({x}, lambda z: greatest(-0.85, least(0.85, z * (0.1 / sqrt(list_sum(list_transform({x}, "
         "lambda q: q * q)) / len({x}))))))")


@query("rms_normalise", f"""WITH e AS (SELECT vec_id, {_DBL} AS s FROM embeddings),
g AS (SELECT vec_id, s, CASE WHEN sqrt(list_sum(list_transform(s, lambda q: q * q)) / len(s)) > 0 THEN
  0.1 / sqrt(list_sum(list_transform(s, lambda q: q * q)) / len(s)) ELSE 1 END AS gain FROM e)
SELECT vec_id, CAST(i - 1 AS INT) AS position, round(greatest(-0.85, least(0.85, s[i] * gain)), 6) AS value
FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM g)""")
def _(t):
    done = t.embeddings.select("vec_id", sg.normalised(F.col("embedding")).alias("s"))
    rows = done.select("vec_id", F.posexplode_outer("s").alias("position", "v")).filter("position IS NOT NULL")
    return rows.select("vec_id", "position", F.round("v", 6).alias("value"))


@query("combined_reference", f"""WITH e AS (SELECT vec_id, label, {_DBL} AS s FROM embeddings),
g AS (SELECT *, 0.1 / sqrt(list_sum(list_transform(s, lambda q: q * q)) / len(s)) AS gain FROM e),
n AS (SELECT label, vec_id, i, greatest(-0.85, least(0.85, s[i] * gain)) AS x FROM
  (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM g)),
w AS (SELECT *, 0.1 / sqrt(avg(x * x) OVER (PARTITION BY label)) AS g2,
  row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS position FROM n)
SELECT label, position, round(greatest(-0.85, least(0.85, x * g2)), 6) AS value FROM w""")
def _(t):
    done = sg.combine_samples(t.embeddings, "label", "vec_id", "embedding")
    rows = done.select("label", "offset", F.posexplode_outer("samples").alias("i", "v")).filter("i IS NOT NULL")
    return rows.select("label", (F.col("offset") + F.col("i")).alias("position"), F.round("v", 6).alias("value"))


@query("overlap_mix", f"""WITH c AS (SELECT label AS story_id, vec_id * 37 % 9973 AS start_ms, vec_id % 5 AS ts, vec_id % 7 AS te,
  CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 1.5 END AS volume, {_DBL} AS s FROM embeddings),
x AS (SELECT story_id, CAST(trunc(start_ms / 1000.0::DOUBLE * 1000) AS BIGINT) + i - ts - 1 AS position, s[i] * volume AS v FROM
  (SELECT *, unnest(range(ts + 1, len(s) - te + 1)) AS i FROM c)),
e AS (SELECT story_id, CAST(trunc(max(start_ms + 64 - ts - te) / 1000.0::DOUBLE * 1000) AS BIGINT) AS fin FROM c GROUP BY 1),
m AS (SELECT story_id, position, sum(v) AS v FROM x JOIN e USING (story_id) WHERE position < fin GROUP BY 1, 2),
w AS (SELECT story_id, unnest(range(fin)) AS position FROM e),
p AS (SELECT story_id, position, coalesce(v, 0) AS v, max(abs(coalesce(v, 0))) OVER (PARTITION BY story_id) AS peak
  FROM w LEFT JOIN m USING (story_id, position))
SELECT story_id, position, round(CASE WHEN peak > 1 THEN v / peak ELSE v END, 6) AS value FROM p""")
def _(t):
    clips = t.embeddings.selectExpr(
        "label AS story_id", "vec_id * 37 % 9973 AS start_ms", "vec_id % 5 AS trim_start_ms", "vec_id % 7 AS trim_end_ms",
        "CASE WHEN vec_id % 2 = 0 THEN 0.5D ELSE 1.5D END AS volume", "0.064D AS duration", "embedding AS samples")
    pieces = sg.overlap_mix(clips, rate=1000)
    return pieces.select("story_id", "piece", F.posexplode_outer("samples").alias("i", "x")).select(
        "story_id", (F.col("piece") * sg.PIECE + F.col("i")).alias("position"), F.round("x", 6).alias("value"))


def _clips(t):
    """Clips with silent stretches, at 1000 samples per second."""
    quiet = lambda n: F.array_repeat(F.lit(0.0), n)
    voice = F.transform("embedding", lambda x: x.cast("double"))
    long_gap = F.when(F.col("vec_id") % 2 == 0, quiet(1300)).otherwise(quiet(300))
    return t.embeddings.select("vec_id", F.lit(1000).alias("sr"), F.concat(
        quiet(100), voice, long_gap, voice, quiet(500)).alias("samples"))


@query("trim_silence", f"""WITH e AS (SELECT vec_id, list_concat(list_transform(range(100), lambda z: 0.0::DOUBLE), {_DBL},
  list_transform(range(CASE WHEN vec_id % 2 = 0 THEN 1300 ELSE 300 END), lambda z: 0.0::DOUBLE), {_DBL},
  list_transform(range(500), lambda z: 0.0::DOUBLE)) AS s FROM embeddings),
f AS (SELECT vec_id, s, len(s) // 20 AS n, list_filter(range(len(s) // 20), lambda i:
  sqrt(list_sum(list_transform(s[i * 20 + 1:i * 20 + 20], lambda x: x * x)) / 20) >= 0.01) AS sp FROM e),
g AS (SELECT *, greatest(0, coalesce(sp[1] - 1, 0)) AS first FROM f),
h AS (SELECT *, list_concat([first - 1], sp, [n]) AS marks FROM g),
k AS (SELECT *, coalesce(marks[list_filter(range(1, len(marks)), lambda j: marks[j + 1] - marks[j] - 1 >= 50)[1]] + 1, n)
  AS fin FROM h),
m AS (SELECT *, least(coalesce(list_max(list_filter(sp, lambda x: x < fin)) + 1, first) + 10, fin) AS stop FROM k),
r AS (SELECT vec_id, s[first * 20 + 1:least(stop * 20, len(s))] AS o FROM m)
SELECT vec_id, CAST(len(o) AS INT) AS kept, round(list_sum(list_transform(range(1, len(o) + 1), lambda i: pow(o[i] *
  CASE WHEN len(o) > 30 AND i > len(o) - 30 THEN pow(cos((i - len(o) + 29) * pi() / 58), 2) ELSE 1 END, 2))), 6) AS energy
FROM r""")
def _(t):
    done = _clips(t).withColumn("out", sg.trim_silence(F.col("samples"), F.col("sr")))
    return done.select("vec_id", F.size("out").alias("kept"), F.round(sg.energy(F.col("out")), 6).alias("energy"))


# Frames of 2,048 samples every 512, centred; silence outside of the clip.
@query("reference_clean_and_check", f"""WITH e AS (SELECT vec_id, list_concat(list_transform(range(100), lambda z: 0.0::DOUBLE), {_DBL},
  list_transform(range(CASE WHEN vec_id % 2 = 0 THEN 1300 ELSE 300 END), lambda z: 0.0::DOUBLE), {_DBL},
  list_transform(range(500), lambda z: 0.0::DOUBLE)) AS s FROM embeddings),
c AS (SELECT vec_id, len(s) AS n, list_transform(s, lambda x: x - m) AS s FROM (SELECT *, list_avg(s) AS m FROM e)),
f AS (SELECT *, list_transform(range(n // 512 + 1), lambda f: greatest(1e-5, sqrt(coalesce(list_sum(list_transform(
  s[greatest(1, f * 512 - 1023):least(n, f * 512 + 1024)], lambda x: x * x)), 0) / 2048))) AS rms FROM c),
l AS (SELECT *, list_filter(range(len(rms)), lambda f: 20 * log10(rms[f + 1] / list_max(rms)) > -40) AS loud FROM f),
k AS (SELECT *, s[loud[1] * 512 + 1:least(n, (loud[-1] + 1) * 512)] AS o FROM l),
r AS (SELECT *, len(o) + 2 * CASE WHEN len(o) < n THEN least(100, (n - len(o)) // 2) ELSE 0 END AS kept,
  list_max(list_transform(o, lambda x: abs(x))) AS peak, list_sum(list_transform(o, lambda x: x * x)) AS power FROM k)
SELECT vec_id, CAST(kept AS INT) AS kept, CASE WHEN kept < 2000 THEN 'Audio too short (minimum 2.0 seconds)'
  WHEN kept > 30000 THEN 'Audio too long (maximum 30.0 seconds)'
  WHEN sqrt(power / kept) * CASE WHEN peak > 0.95 THEN 0.95 / peak ELSE 1 END < 0.01 THEN 'Audio is too quiet or silent' END AS problem
FROM r""")
def _(t):
    done = _clips(t).withColumn("out", sg.clean_reference(F.col("samples"), F.col("sr")))
    return done.select("vec_id", F.size("out").alias("kept"),
                       sg.reference_problem(F.col("out"), F.col("sr")).alias("problem"))


@query("crossfade_join", f"""WITH c AS (SELECT vec_id // 2 AS clip_id, vec_id % 2 AS k, {_DBL} AS s FROM embeddings),
p AS (SELECT a.clip_id, a.s AS a, b.s AS b FROM c a JOIN c b ON a.clip_id = b.clip_id AND a.k = 0 AND b.k = 1)
SELECT clip_id, CAST(i - 1 AS INT) AS position, round(CASE WHEN i <= 44 THEN a[i] WHEN i > 64 THEN b[i - 44]
  ELSE a[i] * (1 - (i - 45) / 19.0) + b[i - 44] * ((i - 45) / 19.0) END, 6) AS value
FROM (SELECT *, unnest(range(1, 109)) AS i FROM p)""")
def _(t):
    chunks = t.embeddings.selectExpr("CAST(floor(vec_id / 2) AS BIGINT) AS clip_id", "vec_id % 2 AS chunk_no",
                                     "embedding AS samples")
    pieces = sg.crossfade_pieces(chunks, rate=1000, crossfade_ms=20)
    rows = numbered_rows(pieces, ["clip_id", "piece"], "samples", "i", "v")
    position = (F.col("piece") * sg.PIECE + F.col("i")).cast("int")
    return rows.select("clip_id", position.alias("position"), F.round("v", 6).alias("value"))
