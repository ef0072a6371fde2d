"""Quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.vectors import cosine
from lectern.operators import quality as qc
from lectern.plans.catalog import _MAPPING, _VOICE_PICK, _mapping
from lectern.plans.domain import ctes
from lectern.plans.registry import query

_BUCKET = ("CASE WHEN {d} <= 0.5 THEN '0.5' WHEN {d} <= 1 THEN '1' WHEN {d} <= 2 THEN '2' WHEN {d} <= 3 THEN '3' "
           "WHEN {d} <= 4 THEN '4' WHEN {d} <= 5 THEN '5' WHEN {d} <= 6 THEN '6' WHEN {d} <= 7 THEN '7' "
           "WHEN {d} <= 10 THEN '10' ELSE '15' END")
_DBL = "list_transform({x}, lambda z: CAST(z AS DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({_DBL.format(x=a)}, {_DBL.format(x=b)})"


@query("cosine_similarity", f"""
SELECT a.vec_id, b.vec_id AS other, round({_cos('a.embedding', 'b.embedding')}, 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"),
                              F.col("embedding").alias("b"))
    return t.embeddings.join(nxt, "vec_id").select(
        "vec_id", "other", F.round(cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


_SCORED = f"""first AS (SELECT * FROM slices QUALIFY row_number() OVER (PARTITION BY voice, slice ORDER BY ord) = 1),
near AS (SELECT a.attempt, a.voice, a.num, a.slot, a.ok, a.duration, f.slice, f.ref_sec,
  CASE WHEN a.duration >= 0.3 THEN {_cos('a.emb', 'f.emb')} END AS score
  FROM attempts a JOIN first f ON f.voice = a.voice
  QUALIFY row_number() OVER (PARTITION BY a.attempt ORDER BY abs(f.ref_sec - a.duration), f.ord) = 1)"""


@query("nearest_reference_slice", ctes("slices", "attempts") + f""", {_SCORED}
SELECT attempt, duration, ref_sec AS matched_ref_sec FROM near WHERE duration >= 0.3""")
def _(t):
    return qc.score_takes(t.attempts, t.slices).filter("matched_ref_sec IS NOT NULL").select(
        "attempt", "duration", "matched_ref_sec")


@query("duration_matched_score", ctes("slices", "attempts") + f""", {_SCORED}
SELECT attempt, voice, round(score, 6) AS score, CASE WHEN duration >= 0.3 THEN ref_sec END AS matched_ref_sec,
  CASE WHEN duration >= 0.3 THEN duration < 1.5 END AS low_confidence,
  CASE WHEN duration < 0.3 THEN 'too_short' END AS reason FROM near""")
def _(t):
    return qc.score_takes(t.attempts, t.slices).select(
        "attempt", "voice", F.round("score", 6).alias("score"), "matched_ref_sec", "low_confidence", "reason")


@query("eligible_slices", """
WITH d AS (SELECT vec_id, (vec_id % 120) / CAST(10 AS DOUBLE) AS duration FROM embeddings)
SELECT vec_id, s.slice, s.ref_sec FROM d, (VALUES ('0.5', CAST(0.5 AS DOUBLE)), ('1', 1), ('2', 2), ('3', 3), ('5', 5))
s(slice, ref_sec) WHERE ref_sec <= duration UNION ALL SELECT vec_id, 'full', duration FROM d""")
def _(t):
    d = t.embeddings.selectExpr("vec_id", "(vec_id % 120) / CAST(10 AS DOUBLE) AS duration")
    return qc.eligible_slices(d, "vec_id", "duration")


@query("fixed_threshold_verdict", ctes("slices", "attempts") + f""", {_SCORED}
SELECT attempt, CASE WHEN round(score, 9) >= 0.7 THEN 'accepted' WHEN score IS NOT NULL THEN 'refused' END AS verdict
FROM near""")
def _(t):
    return qc.score_takes(t.attempts, t.slices).select("attempt", qc.fixed_verdict(F.col("score")).alias("verdict"))


@query("duration_buckets", f"""SELECT bucket, count(*) AS takes FROM (SELECT {_BUCKET.format(d='value / 20')} AS bucket
FROM events) GROUP BY 1""")
def _(t):
    return t.events.groupBy(qc.duration_bucket(F.col("value") / 20).alias("bucket")).agg(F.count("*").alias("takes"))


_STORE = """store AS (SELECT concat('vp-', p_partkey % 8) AS voice_id, list_extract(
  ['0.5', '1', '2', '3', '4', '5', '6', '7', '10', '15'], CAST(p_size % 10 + 1 AS INT)) AS bucket,
  CAST(max(p_size + p_partkey % 31) AS DOUBLE) AS pct FROM part WHERE p_size % 3 > 0 GROUP BY 1, 2)"""


def _store(t):
    names = "array('0.5', '1', '2', '3', '4', '5', '6', '7', '10', '15')"
    return t.part.filter("p_size % 3 > 0").selectExpr(
        "concat('vp-', p_partkey % 8) AS voice_id", f"{names}[p_size % 10] AS bucket",
        "p_size + p_partkey % 31 AS v").groupBy("voice_id", "bucket").agg(F.max("v").cast("double").alias("pct"))


@query("default_threshold_fill", ctes("voices") + f""", {_STORE},
d AS (SELECT voice_id, b.bucket, b.pct FROM (SELECT DISTINCT voice_id FROM voices), (VALUES ('0.5', 19), ('1', 25), ('2', 33),
 ('3', 43), ('4', 47), ('5', 53), ('6', 60), ('7', 65), ('10', 70)) b(bucket, pct))
SELECT coalesce(d.voice_id, s.voice_id) AS voice_id, coalesce(d.bucket, s.bucket) AS bucket,
  coalesce(s.pct, CAST(d.pct AS DOUBLE)) AS pct FROM d FULL JOIN store s ON s.voice_id = d.voice_id AND s.bucket = d.bucket""")
def _(t):
    return qc.with_default_thresholds(_store(t), t.voices)


@query("segment_threshold", ctes("segments", "voices") + f""", {_MAPPING}, {_STORE} {_VOICE_PICK},
n AS (SELECT s.project, s.num, coalesce(s.generated_voice, m.voice) AS voice_name,
  {_BUCKET.format(d='s.qc_duration')} AS bucket FROM segments s
  LEFT JOIN mapping m ON m.project = s.project AND m.role = s.profile_id)
SELECT n.project, n.num, n.voice_name, n.bucket, st.pct FROM n LEFT JOIN e ON e.name = n.voice_name
LEFT JOIN l ON l.key = lower(trim(n.voice_name))
LEFT JOIN store st ON st.voice_id = coalesce(e.voice_id, l.voice_id) AND st.bucket = n.bucket""")
def _(t):
    return qc.segment_thresholds(t.segments, _mapping(t), t.voices, _store(t)).select(
        "project", "num", "voice_name", "bucket", "pct")


# A mapping whose voices exist in the index, so that roles do have thresholds.
_MAP2 = """mapping2 AS (SELECT DISTINCT conv_id AS project, upper(role) AS role, concat('voice ', (conv_id + length(role)) % 14)
  AS voice FROM conversations)"""


def _mapping2(t):
    return t.conversations.selectExpr("conv_id AS project", "upper(role) AS role",
                                      "concat('voice ', (conv_id + length(role)) % 14) AS voice").distinct()


@query("role_threshold_view", ctes("voices") + f""", {_MAP2}, {_STORE} {_VOICE_PICK}
SELECT m.project, m.role, s.bucket, s.pct FROM mapping2 m JOIN l ON l.key = m.voice JOIN store s USING (voice_id)""")
def _(t):
    return qc.role_thresholds(_mapping2(t), t.voices, _store(t))


@query("adopt_role_thresholds", ctes("voices") + f""", {_MAP2}, {_STORE} {_VOICE_PICK},
small AS (SELECT * FROM store WHERE voice_id IN ('vp-1', 'vp-2')),
old AS (SELECT DISTINCT conv_id AS project, upper(role) AS role, CASE WHEN turn % 2 = 0 THEN '1' ELSE '5' END AS bucket,
  CAST(conv_id % 90 AS DOUBLE) AS pct FROM conversations),
r AS (SELECT o.*, l.voice_id FROM old o JOIN mapping2 m USING (project, role) JOIN l ON l.key = m.voice
  WHERE l.voice_id NOT IN (SELECT voice_id FROM small)),
f AS (SELECT voice_id, min((project, role)) AS w FROM r GROUP BY 1)
SELECT voice_id, bucket, pct FROM small UNION ALL SELECT r.voice_id, bucket, pct FROM r JOIN f
ON f.voice_id = r.voice_id AND f.w = (r.project, r.role)""")
def _(t):
    old = t.conversations.selectExpr(
        "conv_id AS project", "upper(role) AS role", "CASE WHEN turn % 2 = 0 THEN '1' ELSE '5' END AS bucket",
        "CAST(conv_id % 90 AS DOUBLE) AS pct").distinct()
    small = _store(t).filter("voice_id IN ('vp-1', 'vp-2')")
    return qc.adopt_role_thresholds(old, _mapping2(t), t.voices, small)


@query("anomaly_queue", ctes("segments", "voices") + f""", {_MAP2}, {_STORE} {_VOICE_PICK},
vt AS (SELECT e.name AS voice_name, s.bucket, s.pct FROM e JOIN store s USING (voice_id)),
rt AS (SELECT m.project, m.role, s.bucket, s.pct FROM mapping2 m JOIN l ON l.key = m.voice JOIN store s USING (voice_id)),
b AS (SELECT *, {_BUCKET.format(d='qc_duration')} AS bucket FROM segments WHERE has_audio),
j AS (SELECT b.*, CASE WHEN b.generated_voice IN (SELECT voice_name FROM vt) THEN vt.pct ELSE rt.pct END AS threshold
  FROM b LEFT JOIN vt ON vt.voice_name = b.generated_voice AND vt.bucket = b.bucket
  LEFT JOIN rt ON rt.project = b.project AND rt.role = b.profile_id AND rt.bucket = b.bucket)
SELECT project, num, qc_status, threshold FROM j WHERE coalesce(qc_status, '') = 'force_refused'
OR (coalesce(qc_status, '') NOT IN ('forced', 'accepted') AND threshold IS NOT NULL
  AND (qc_score IS NULL OR floor(qc_score * 100 + 0.5) < threshold))""")
def _(t):
    names = t.voices.select(F.col("name").alias("voice_name"), "voice_id").distinct()
    by_voice = names.join(_store(t), "voice_id").select("voice_name", "bucket", "pct")
    by_role = qc.role_thresholds(_mapping2(t), t.voices, _store(t))
    return qc.anomalies(t.segments, by_voice, by_role).select("project", "num", "qc_status", "threshold")


def _choose_sql(keys: str, slot_mode: bool) -> str:
    last = "'passed', 'unscored'" if slot_mode else "'passed'"
    return f""", {_SCORED},
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY attempt) AS r, 10 + num AS threshold,
  CAST(round_even(round(score, 9) * 100, 0) AS BIGINT) AS pct FROM near QUALIFY r <= 20),
s AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN score IS NULL THEN 'unscored' WHEN pct >= threshold THEN 'passed' END
  AS fin FROM r),
z AS (SELECT *, min(CASE WHEN fin IS NOT NULL THEN r END) OVER (PARTITION BY {keys}) AS stop,
  count(*) OVER (PARTITION BY {keys}) AS n FROM s)
SELECT {keys},
  coalesce(max(CASE WHEN r = stop AND fin IN ({last}) THEN attempt END),
    arg_max(attempt, (pct, -r)) FILTER (stop IS NULL OR r < stop)) AS attempt,
  CASE WHEN max(CASE WHEN r = stop AND fin IN ({last}) THEN 1 END) = 1 THEN max(CASE WHEN r = stop THEN pct END)
    ELSE max(pct) FILTER (stop IS NULL OR r < stop) END AS pct,
  coalesce(bool_or(r = stop AND fin = 'passed'), false) AS passed,
  CAST(coalesce(max(stop), max(n)) AS INT) AS tries FROM z GROUP BY {keys}"""


def _attempts(t):
    return qc.score_takes(t.attempts, t.slices).withColumn("score", F.round("score", 9)).withColumn(
        "threshold", 10 + F.col("num"))


@query("take_selection_single", ctes("slices", "attempts") + _choose_sql("num", False))
def _(t):
    return qc.choose_takes(_attempts(t), ["num"])


@query("take_selection_slots", ctes("slices", "attempts") + _choose_sql("num, slot", True))
def _(t):
    return qc.choose_takes(_attempts(t), ["num", "slot"], slot_mode=True)


@query("slots_produced", ctes("slices", "attempts") + "SELECT num, count(attempt) AS produced, count(*) AS slots FROM ("
       + _choose_sql("num, slot", True).replace(", first AS", "WITH first AS", 1) + ") GROUP BY 1")
def _(t):
    return qc.slots_produced(qc.choose_takes(_attempts(t), ["num", "slot"], slot_mode=True), ["num"])


@query("version_score_sheet", ctes("slices", "attempts") + f""", {_SCORED}
SELECT num, CASE WHEN slot = 0 THEN 'main' ELSE concat('v', attempt) END AS version, round(score, 6) AS score, duration,
  CASE WHEN duration >= 0.3 THEN ref_sec END AS matched_ref_sec FROM near WHERE ok""")
def _(t):
    scored = qc.score_takes(t.attempts.filter("ok"), t.slices)
    version = F.when(F.col("slot") == 0, "main").otherwise(F.concat(F.lit("v"), F.col("attempt").cast("string")))
    return scored.select("num", version.alias("version"), F.round("score", 6).alias("score"), "duration",
                         "matched_ref_sec")


@query("bulk_rescore", ctes("slices", "attempts") + f""", {_SCORED}
SELECT voice, count(*) AS rescored, count(score) AS rated, round(avg(score), 6) AS mean_score FROM near
WHERE ok AND slot = 1 GROUP BY 1""")
def _(t):
    wanted = t.attempts.filter("ok AND slot = 1")
    return qc.score_takes(wanted, t.slices).groupBy("voice").agg(
        F.count("*").alias("rescored"), F.count("score").alias("rated"), F.round(F.avg("score"), 6).alias("mean_score"))


# Audio of a segment: one of the given vectors.  Every twelfth length is too short to judge, some voices have no print.
_AUDIO = """audio AS (SELECT conv_id AS project, CAST(turn + 1 AS INT) AS num, (conv_id * 5 + turn) % 120 / CAST(10 AS DOUBLE)
  AS duration, embedding AS emb FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn) % 97)"""


def _rescore_sql(role: str) -> str:
    return ctes("segments", "slices", "voices") + f""", {_MAP2}, {_AUDIO},
l AS (SELECT lower(name) AS key, min_by(voice_id, ord) AS voice_id FROM voices GROUP BY 1),
n AS (SELECT s.project, s.num, s.qc_score, s.qc_duration, coalesce(s.generated_voice, m.voice) AS voice_name FROM segments s
  LEFT JOIN mapping2 m ON m.project = s.project AND m.role = s.profile_id WHERE s.has_audio AND {role}),
i AS (SELECT n.*, l.voice_id, a.duration, a.emb FROM n JOIN audio a USING (project, num) LEFT JOIN l ON l.key = lower(n.voice_name)),
first AS (SELECT * FROM slices WHERE voice % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY voice, slice ORDER BY ord) = 1),
b AS (SELECT i.*, f.emb AS ref, f.voice IS NOT NULL OR (i.voice_id IS NOT NULL AND i.duration < 0.3) AS rescored FROM i
  LEFT JOIN first f ON concat('vp-', f.voice) = i.voice_id
  QUALIFY row_number() OVER (PARTITION BY i.project, i.num ORDER BY abs(f.ref_sec - i.duration), f.ord) = 1)
SELECT project, num, voice_name, voice_id, rescored, round(CASE WHEN NOT rescored THEN qc_score WHEN duration >= 0.3 THEN
  {_cos('emb', 'ref')} END, 6) AS qc_score, CASE WHEN rescored THEN duration ELSE qc_duration END AS qc_duration FROM b"""


def _rescored(t, role):
    audio = t.conversations.withColumn("vec_id", F.expr("(conv_id * 7 + turn) % 97")).join(
        t.embeddings.select("vec_id", "embedding"), "vec_id").selectExpr(
        "conv_id AS project", "CAST(turn + 1 AS INT) AS num", "(conv_id * 5 + turn) % 120 / CAST(10 AS DOUBLE) AS duration",
        "embedding AS emb")
    slices = t.slices.filter("voice % 4 <> 1").withColumn("voice", F.expr("concat('vp-', voice)"))
    done = qc.rescore(t.segments, audio, _mapping2(t), t.voices, slices, role)
    return done.withColumn("qc_score", F.round("qc_score", 6))


@query("rescore_segments", _rescore_sql("true"))
def _(t):
    return _rescored(t, "all")


@query("rescore_role", _rescore_sql("s.profile_id = 'USER'"))
def _(t):
    return _rescored(t, " USER ")


@query("new_audio_reset", ctes("segments", "takes") + """
SELECT project, num, CASE WHEN x THEN 0 ELSE read END AS read, CASE WHEN NOT x THEN qc_status END AS qc_status,
  CASE WHEN NOT x THEN qc_score END AS qc_score FROM (SELECT *, EXISTS (SELECT 1 FROM takes k WHERE
  k.project = s.project AND k.num = s.num AND k.version = 'main') AS x FROM segments s)""")
def _(t):
    return qc.reset_for_new_audio(t.segments, t.takes.filter("version = 'main'")).select(
        "project", "num", "read", "qc_status", "qc_score")


_MORE = """, more AS (SELECT conv_id AS project, CAST(turn + 1 AS INT) AS num, v AS version FROM conversations,
  (SELECT unnest(['main', 'v1', 'v2']) AS v)),
pick AS (SELECT conv_id AS project, CAST(turn + 1 AS INT) AS num, CASE WHEN conv_id % 2 = 0 THEN 'v2' ELSE 'v9' END
  AS version FROM conversations WHERE role = 'user')"""


@query("version_promotion", "WITH dummy AS (SELECT 1)" + _MORE + """
SELECT m.project, m.num, CASE WHEN p.version IS NOT NULL THEN 'main' ELSE m.version END AS version FROM more m
LEFT JOIN pick p ON p.project = m.project AND p.num = m.num AND p.version = 'v2'
WHERE p.version IS NULL OR m.version = p.version""")
def _(t):
    c = t.conversations.selectExpr("conv_id AS project", "CAST(turn + 1 AS INT) AS num", "role", "conv_id")
    takes = c.select("project", "num", F.explode(F.array(F.lit("main"), F.lit("v1"), F.lit("v2"))).alias("version"))
    pick = c.filter("role = 'user'").select("project", "num", F.when(F.col("conv_id") % 2 == 0, "v2")
                                            .otherwise("v9").alias("version"))
    return qc.promote_version(takes, pick)


@query("promotion_marks_read", ctes("segments", "takes") + """
SELECT project, num, CASE WHEN (project, num) IN (SELECT (project, num) FROM takes WHERE version = 'v1') THEN 1 ELSE read END
AS read FROM segments""")
def _(t):
    return qc.mark_read(t.segments, t.takes.filter("version = 'v1'")).select("project", "num", "read")
