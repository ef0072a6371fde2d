"""Segment catalogue, validation and source selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import catalog as cat
from lectern.operators import validation as val
from lectern.operators.ordered import block_of, ordered_scan, running_sum
from lectern.plans.domain import ctes
from lectern.plans.registry import query

_SEG = "segments"

# A range expression per project, with ranges, single numbers, noise and "all".
_EXPR = ("CASE WHEN conv_id % 7 = 0 THEN 'all' ELSE concat('1-', conv_id % 4, ', x, ', 3 + conv_id % 5, ',7-', "
         "4 + conv_id % 3) END")


def _expr(t):
    return t.conversations.selectExpr("conv_id AS project", "CAST(turn + 1 AS INT) AS num", f"{_EXPR} AS expr")


@query("range_selection", f"""
WITH s AS (SELECT conv_id AS project, CAST(turn + 1 AS INT) AS num, {_EXPR} AS expr FROM conversations)
SELECT project, num, expr FROM s WHERE expr = 'all' OR num BETWEEN 1 AND project % 4 OR num = 3 + project % 5
  OR num BETWEEN 7 AND 4 + project % 3""")
def _(t):
    return _expr(t).filter(cat.in_ranges(F.col("num"), F.col("expr")))


@query("range_selection_swapped", f"""
WITH s AS (SELECT conv_id AS project, CAST(turn + 1 AS INT) AS num, {_EXPR} AS expr FROM conversations)
SELECT project, num, expr FROM s WHERE expr = 'all' OR num BETWEEN least(1, project % 4) AND greatest(1, project % 4)
  OR num = 3 + project % 5 OR num BETWEEN 4 + project % 3 AND 7""")
def _(t):
    return _expr(t).filter(cat.in_ranges(F.col("num"), F.col("expr"), swap_reversed=True))


@query("range_selection_strict", ctes(_SEG) + """
SELECT project, num FROM segments WHERE num BETWEEN 1 AND 2 OR num = 5 OR num BETWEEN 7 AND 9""")
def _(t):
    return cat.select_strict(t.segments, "num", "1-2,5,7-9").select("project", "num")


@query("role_filter", ctes(_SEG) + "SELECT project, num, profile_id FROM segments WHERE profile_id = 'ASSISTANT'")
def _(t):
    return cat.role_filter(cat.role_filter(t.segments, "Tous les acteurs"), "ASSISTANT").select(
        "project", "num", "profile_id")


@query("batch_target", ctes(_SEG) + """
SELECT project, num FROM segments WHERE profile_id = 'USER' AND (num BETWEEN 2 AND 4)""")
def _(t):
    return cat.select_strict(cat.role_filter(t.segments, "USER"), "num", "2-4").select("project", "num")


_TAKES = """, k AS (SELECT project, num, bool_or(version = 'main') AS has_main,
  count(*) FILTER (version <> 'main') AS version_count FROM takes GROUP BY 1, 2)"""


@query("segments_with_takes", ctes(_SEG, "takes") + _TAKES + """
SELECT s.project, s.num, coalesce(has_main, false) AS has_main, coalesce(version_count, 0) AS version_count,
  CASE WHEN has_main THEN coalesce(read, 1) ELSE 1 END AS read FROM segments s LEFT JOIN k USING (project, num)""")
def _(t):
    return cat.with_takes(t.segments, t.takes).select("project", "num", "has_main", "version_count", "read")


@query("segments_with_any_audio", ctes(_SEG, "takes") + _TAKES + """
SELECT s.project, s.num FROM segments s JOIN k USING (project, num) WHERE has_main OR version_count > 0""")
def _(t):
    return cat.with_takes(t.segments, t.takes).filter(cat.any_audio()).select("project", "num")


@query("version_natural_order", """
WITH t AS (SELECT l_suppkey AS project, CAST(l_linenumber AS INT) AS num, concat('v', l_partkey) AS version,
  l_partkey AS k FROM lineitem GROUP BY ALL)
SELECT project, num, version, row_number() OVER (PARTITION BY project, num ORDER BY k, version) AS rank FROM t""")
def _(t):
    takes = t.lineitem.select(F.col("l_suppkey").alias("project"), F.col("l_linenumber").alias("num"),
                              F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("version")).distinct()
    return cat.versions_in_number_order(takes).select("project", "num", "version", "rank")


@query("neighbour_segments", ctes(_SEG) + """
SELECT project, num, last_value(CASE WHEN has_audio THEN num END IGNORE NULLS) OVER (PARTITION BY project ORDER BY num
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_audio,
  first_value(CASE WHEN has_audio THEN num END IGNORE NULLS) OVER (PARTITION BY project ORDER BY num
   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_audio
FROM segments WHERE profile_id = 'USER'""")
def _(t):
    return cat.neighbours_with_audio(t.segments, "USER").select("project", "num", "previous_audio", "next_audio")


_LISTING = """listing AS (SELECT source AS project, CASE doc_id % 6 WHEN 0 THEN 'book' WHEN 1 THEN 'tts' WHEN 2 THEN ''
  ELSE 'audio' END AS folder, CASE doc_id % 6 WHEN 0 THEN concat('seg', doc_id, '.txt') WHEN 1 THEN
  concat('seg', doc_id, '.json') WHEN 2 THEN CASE WHEN doc_id % 40 = 2 THEN 'Final.MP3' ELSE 'meta.json' END
  WHEN 3 THEN concat('x', doc_id, '.wav') ELSE concat('seg', doc_id, '.wav') END AS name FROM documents
  UNION ALL SELECT source, 'book', concat(source, '_PARSED.txt') FROM documents WHERE lang = 'de' AND source LIKE '%1%'),
meta AS (SELECT DISTINCT source AS project, CASE WHEN source LIKE '%3' THEN 'novel_multi' END AS type FROM documents
  WHERE source LIKE '%3' OR source LIKE '%7')"""


def _listing(t):
    d = t.documents
    base = d.selectExpr(
        "source AS project",
        "CASE doc_id % 6 WHEN 0 THEN 'book' WHEN 1 THEN 'tts' WHEN 2 THEN '' ELSE 'audio' END AS folder",
        "CASE doc_id % 6 WHEN 0 THEN concat('seg', doc_id, '.txt') WHEN 1 THEN concat('seg', doc_id, '.json') WHEN 2 "
        "THEN CASE WHEN doc_id % 40 = 2 THEN 'Final.MP3' ELSE 'meta.json' END WHEN 3 THEN concat('x', doc_id, '.wav') "
        "ELSE concat('seg', doc_id, '.wav') END AS name")
    parsed = d.filter("lang = 'de' AND source LIKE '%1%'").selectExpr(
        "source AS project", "'book' AS folder", "concat(source, '_PARSED.txt') AS name")
    meta = d.filter("source LIKE '%3' OR source LIKE '%7'").selectExpr(
        "source AS project", "CASE WHEN source LIKE '%3' THEN 'novel_multi' END AS type").distinct()
    return base.unionByName(parsed), meta


@query("project_summary", f"WITH {_LISTING}" + """
, c AS (SELECT project, count(*) FILTER (folder = 'book' AND name LIKE 'seg%.txt') AS tx,
  count(*) FILTER (folder = 'tts' AND name LIKE 'seg%.json') AS js,
  count(*) FILTER (folder = 'audio' AND name LIKE 'seg%.wav') AS generated_audio,
  bool_or(folder = '' AND lower(name) LIKE '%.mp3') AS has_final_mp3,
  bool_or(folder = 'book' AND lower(name) LIKE '%$_parsed.txt' ESCAPE '$') AS parsed FROM listing GROUP BY 1)
SELECT c.project, CASE WHEN m.project IS NOT NULL THEN coalesce(m.type, 'novel') WHEN parsed THEN 'theatre'
  ELSE 'novel' END AS type, greatest(tx, js) AS total_segments, generated_audio, has_final_mp3
FROM c LEFT JOIN meta m USING (project)""")
def _(t):
    return cat.project_summary(*_listing(t))


@query("completion_percent", """
SELECT conv_id AS project, CAST(CASE WHEN count(*) FILTER (turn > 0) > 0 THEN floor(100 * count(*) FILTER (turn > 0
  AND role = 'user') / count(*) FILTER (turn > 0) + 0.5) ELSE 0 END AS BIGINT) AS percent
FROM conversations GROUP BY 1""")
def _(t):
    return t.conversations.groupBy(F.col("conv_id").alias("project")).agg(cat.percent(
        F.count_if((F.col("turn") > 0) & (F.col("role") == "user")), F.count_if(F.col("turn") > 0)).alias("percent"))


@query("characters_by_project", ctes(_SEG) + "SELECT DISTINCT project, profile_id FROM segments")
def _(t):
    return cat.characters(t.segments)


_VOICE_PICK = """, e AS (SELECT name, arg_min(voice_id, ord) AS voice_id FROM voices GROUP BY 1),
l AS (SELECT lower(trim(name)) AS key, arg_min(voice_id, ord) AS voice_id FROM voices GROUP BY 1)"""


@query("voices_used", ctes(_SEG, "voices") + _VOICE_PICK + """
SELECT DISTINCT s.project, s.generated_voice AS voice_name, e.voice_id FROM segments s
LEFT JOIN e ON e.name = s.generated_voice WHERE generated_voice IS NOT NULL""")
def _(t):
    return cat.voices_used(t.segments, t.voices)


@query("several_voices_flag", ctes(_SEG) + """
SELECT project, count(DISTINCT generated_voice) > 1 AS several_voices FROM segments GROUP BY 1""")
def _(t):
    return cat.several_voices(t.segments)


_NAMES = """n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('Voice ', user_id % 12)
  WHEN 1 THEN concat('  VOICE ', user_id % 12, ' ') WHEN 2 THEN 'nobody' ELSE concat('voice ', user_id % 12) END
  AS voice_name FROM events)"""
_NAME_EXPR = ("CASE event_id % 4 WHEN 0 THEN concat('Voice ', user_id % 12) WHEN 1 THEN concat('  VOICE ', "
              "user_id % 12, ' ') WHEN 2 THEN 'nobody' ELSE concat('voice ', user_id % 12) END AS voice_name")


@query("voice_name_resolution", ctes("voices") + f", {_NAMES} {_VOICE_PICK}" + """
SELECT n.event_id, n.voice_name, coalesce(e.voice_id, l.voice_id) AS voice_id FROM n
LEFT JOIN e ON e.name = n.voice_name LEFT JOIN l ON l.key = lower(trim(n.voice_name))""")
def _(t):
    return cat.voice_ids(t.events.selectExpr("event_id", _NAME_EXPR), t.voices)


@query("profile_lookup", ctes("profiles") + """
, w AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE
  concat('cusTomer#', lpad(CAST(event_id % 1700 AS STRING), 9, '0')) END AS wanted FROM events)
SELECT w.event_id, w.wanted, coalesce(a.id, b.id) AS profile_id FROM w LEFT JOIN profiles a
ON CAST(a.id AS VARCHAR) = w.wanted LEFT JOIN profiles b ON lower(b.name) = lower(w.wanted)""")
def _(t):
    wanted = t.events.selectExpr(
        "event_id", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE concat('cusTomer#', "
        "lpad(CAST(event_id % 1700 AS STRING), 9, '0')) END AS wanted")
    return cat.profile_lookup(wanted, t.profiles)


_MAPPING = """mapping AS (SELECT DISTINCT conv_id AS project, CASE role WHEN 'system' THEN 'NARRATEUR' ELSE upper(role)
  END AS role, CASE WHEN conv_id % 5 = 0 AND role = 'user' THEN 'DIDAS' ELSE concat('Voice ', conv_id % 9, role) END
  AS voice FROM conversations WHERE conv_id % 8 <> 0 OR role = 'user')"""


def _mapping(t):
    return t.conversations.filter("conv_id % 8 <> 0 OR role = 'user'").selectExpr(
        "conv_id AS project", "CASE role WHEN 'system' THEN 'NARRATEUR' ELSE upper(role) END AS role",
        "CASE WHEN conv_id % 5 = 0 AND role = 'user' THEN 'DIDAS' ELSE concat('Voice ', conv_id % 9, role) END AS voice"
    ).distinct()


@query("segment_voice_resolution", ctes(_SEG) + f", {_MAPPING}" + """
SELECT s.project, s.num, s.profile_id, CASE WHEN s.generated_voice <> '' THEN s.generated_voice
  WHEN m.voice <> 'DIDAS' AND s.profile_id NOT IN ('Narrator', 'NARRATEUR', 'DIDAS') THEN m.voice ELSE n.voice END
  AS voice_name
FROM segments s LEFT JOIN mapping m ON m.project = s.project AND m.role = s.profile_id
LEFT JOIN mapping n ON n.project = s.project AND n.role = 'NARRATEUR'""")
def _(t):
    return cat.segment_voice(t.segments, _mapping(t)).select("project", "num", "profile_id", "voice_name")


@query("play_voice_resolution", ctes(_SEG) + f", {_MAPPING}" + """
SELECT s.project, s.num, CASE WHEN coalesce(m.voice, s.profile_id) = 'DIDAS' THEN 'Stage voice'
  ELSE coalesce(m.voice, s.profile_id) END AS voice_name
FROM segments s LEFT JOIN mapping m ON m.project = s.project AND m.role = s.profile_id""")
def _(t):
    return cat.play_voice(t.segments, _mapping(t), "Stage voice").select("project", "num", "voice_name")


@query("voices_to_refresh", ctes(_SEG) + """
SELECT DISTINCT project, coalesce(generated_voice, profile_id) AS voice_name FROM segments""")
def _(t):
    return cat.voices_to_refresh(t.segments)


@query("character_list_clean", """
WITH n AS (SELECT conv_id, unnest([concat(' ', role, ' '), 'l’ami', '', max_role]) AS x FROM
 (SELECT conv_id, role, max(role) OVER (PARTITION BY conv_id, turn) AS max_role FROM conversations)
 UNION ALL SELECT conv_id, 'DIDAS' FROM conversations)
SELECT conv_id, string_agg(DISTINCT u, '|' ORDER BY u) AS cast_list FROM (SELECT conv_id,
  replace(upper(trim(x)), '’', '''') AS u FROM n) WHERE u <> '' GROUP BY 1""")
def _(t):
    per = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("roles"))  # at most three roles exist
    names = F.concat(F.transform("roles", lambda r: F.concat(F.lit(" "), r, F.lit(" "))),
                     F.array(F.lit("l’ami"), F.lit("")), F.col("roles"))
    return per.select("conv_id", F.array_join(cat.clean_characters(names, "theatre"), "|").alias("cast_list"))


@query("character_union", ctes(_SEG) + f", {_MAPPING}" + """
SELECT DISTINCT project, role FROM (SELECT project, role FROM mapping UNION ALL SELECT project, profile_id
FROM segments UNION ALL SELECT project, 'NARRATEUR' FROM mapping) WHERE role <> 'Narrator'""")
def _(t):
    return cat.all_characters(_mapping(t), t.segments)


_SPLITS = """, splits AS (SELECT conv_id AS project, CAST(turn + 1 AS INT) AS num, substr(text, 1, 10) AS part1,
  substr(text, 11) AS part2 FROM conversations WHERE role = 'assistant')"""


def _splits(t):
    return t.conversations.filter("role = 'assistant'").selectExpr(
        "conv_id AS project", "CAST(turn + 1 AS INT) AS num", "substr(text, 1, 10) AS part1",
        "substr(text, 11) AS part2")


@query("renumber_after_split", ctes(_SEG) + _SPLITS + """
, m AS (SELECT s.*, p.part1, p.part2, coalesce(sum(CASE WHEN p.num IS NOT NULL THEN 1 ELSE 0 END) OVER (
  PARTITION BY s.project ORDER BY s.num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM segments s LEFT JOIN splits p USING (project, num))
SELECT project, profile_id, CAST(num + k AS INT) AS num, coalesce(part1, text) AS text, part1 IS NOT NULL AS is_new FROM m
UNION ALL SELECT project, profile_id, CAST(num + k + 1 AS INT), part2, true FROM m WHERE part1 IS NOT NULL""")
def _(t):
    return cat.split_segments(t.segments, _splits(t))


@query("takes_after_split", ctes(_SEG, "takes") + _SPLITS + """
, m AS (SELECT s.project, s.num, p.num IS NOT NULL AS cut, coalesce(sum(CASE WHEN p.num IS NOT NULL THEN 1 ELSE 0 END)
  OVER (PARTITION BY s.project ORDER BY s.num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM segments s LEFT JOIN splits p USING (project, num))
SELECT t.project, CAST(t.num + k AS INT) AS num, t.version FROM takes t JOIN m USING (project, num) WHERE NOT cut""")
def _(t):
    return cat.takes_after_split(t.takes, t.segments, _splits(t)).select("project", "num", "version")


@query("renumber_after_delete", ctes(_SEG) + """
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY num) AS INT) AS num, text FROM segments
WHERE profile_id <> 'USER'""")
def _(t):
    return cat.delete_segments(t.segments, t.segments.filter("profile_id = 'USER'")).select("project", "num", "text")


@query("shift_segment_range", ctes(_SEG) + """
, a AS (SELECT project, CAST(num - 2 AS INT) AS num, text, 0 AS pref FROM segments WHERE num BETWEEN 3 AND 4
  UNION ALL SELECT project, num, text, 1 FROM segments WHERE num NOT BETWEEN 3 AND 4)
SELECT project, num, text FROM a QUALIFY row_number() OVER (PARTITION BY project, num ORDER BY pref) = 1""")
def _(t):
    return cat.shift_range(t.segments, 3, 4, -2).select("project", "num", "text")


@query("log_ring_buffer", """
SELECT event_type, event_id, ts FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500""")
def _(t):
    return cat.latest_lines(t.events.select("event_type", "event_id", "ts"), "event_type", ["ts", "event_id"])


@query("global_queue_position", """
SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS position FROM events""")
def _(t):
    return cat.queue_positions(t.events.select("event_id", "ts"))


@query("enqueue_missing", """
SELECT DISTINCT l_suppkey AS project, l_orderkey AS num FROM lineitem WHERE (l_suppkey, l_orderkey) NOT IN
(SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def _(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("num"), "l_returnflag")
    return cat.enqueue_missing(pairs, pairs.filter("l_returnflag = 'A'").select("project", "num"))


@query("chunks_with_analysis", """
SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS analysed FROM documents d""")
def _(t):
    seen = t.labels.select("doc_id", F.lit(True).alias("analysed")).distinct()
    return t.documents.select("doc_id").join(seen, "doc_id", "left").fillna(False, ["analysed"])


@query("same_id_sets", """
WITH a AS (SELECT l_orderkey AS k, l_partkey AS id FROM lineitem WHERE l_linenumber <= 4),
b AS (SELECT l_orderkey AS k, l_partkey AS id FROM lineitem WHERE l_linenumber <= 6)
SELECT DISTINCT k, NOT EXISTS (SELECT 1 FROM b y WHERE y.k = x.k AND y.id NOT IN
  (SELECT id FROM a z WHERE z.k = x.k)) AS same FROM a x""")
def _(t):
    # Set equality without building either set: every (key, id) must be seen on both sides.
    pair = [F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id")]
    left = t.lineitem.filter("l_linenumber <= 4").select(*pair, F.lit(1).alias("l"), F.lit(0).alias("r"))
    right = t.lineitem.filter("l_linenumber <= 6").select(*pair, F.lit(0).alias("l"), F.lit(1).alias("r"))
    seen = left.unionByName(right).groupBy("k", "id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.groupBy("k").agg(F.max("l").alias("any_left"), F.min(F.least("l", "r")).alias("both")).filter(
        "any_left = 1").select("k", (F.col("both") == 1).alias("same"))


@query("play_source_choice", ctes("artifacts") + """
SELECT project, name FROM artifacts QUALIFY row_number() OVER (PARTITION BY project ORDER BY CASE WHEN name LIKE
'%$_chunked.txt' ESCAPE '$' THEN 0 WHEN name LIKE '%$_parsed.txt' ESCAPE '$' THEN 1 WHEN name NOT LIKE 'seg%' THEN 2
ELSE 9 END, name) = 1""")
def _(t):
    return cat.play_source(t.artifacts)


@query("book_source_choice", ctes("artifacts") + """
SELECT project, name FROM artifacts QUALIFY row_number() OVER (PARTITION BY project ORDER BY CASE WHEN name LIKE
'%$_chunked.txt' ESCAPE '$' THEN 0 WHEN name NOT LIKE 'seg%' THEN 1 ELSE 9 END, name) = 1""")
def _(t):
    return cat.book_source(t.artifacts)


@query("attribution_source_choice", """
WITH f AS (SELECT source AS project, n_chars AS size, concat(CASE WHEN doc_id % 13 = 0 THEN 'backup_' WHEN doc_id % 17 = 0
  THEN 'seg' ELSE 'book' END, doc_id, CASE WHEN doc_id % 5 = 0 AND lang = 'de' THEN '_formated' WHEN doc_id % 5 = 1 THEN
  '_parsed' ELSE '' END, '.txt') AS name FROM documents)
SELECT project, name FROM f WHERE name NOT LIKE 'seg%' AND name NOT LIKE '%$_parsed.txt' ESCAPE '$'
QUALIFY row_number() OVER (PARTITION BY project ORDER BY CASE WHEN name LIKE '%$_formated.txt' ESCAPE '$' THEN 0
  WHEN name LIKE '%backup%' THEN 2 ELSE 1 END, CASE WHEN name LIKE '%$_formated.txt' ESCAPE '$' THEN 0 ELSE -size END,
  name) = 1""")
def _(t):
    return cat.attribution_source(t.documents.selectExpr(
        "source AS project", "n_chars AS size",
        "concat(CASE WHEN doc_id % 13 = 0 THEN 'backup_' WHEN doc_id % 17 = 0 THEN 'seg' ELSE 'book' END, doc_id, "
        "CASE WHEN doc_id % 5 = 0 AND lang = 'de' THEN '_formated' WHEN doc_id % 5 = 1 THEN '_parsed' ELSE '' END, "
        "'.txt') AS name"))


@query("artefact_inventory", ctes("artifacts") + """
, k AS (SELECT project, name, CASE WHEN name LIKE '%chunked.txt' THEN 'c' WHEN name LIKE '%parsed.txt' THEN 'p'
  WHEN name LIKE '%formated.txt' THEN 'f' ELSE 's' END AS kind FROM artifacts WHERE name NOT LIKE 'seg%'),
a AS (SELECT project, max(name) FILTER (kind = 's') AS source_file, max(name) FILTER (kind = 'f') AS formated_file,
  max(name) FILTER (kind = 'p') AS parsed_file, max(name) FILTER (kind = 'c') AS chunked_file FROM k GROUP BY 1)
SELECT *, coalesce(chunked_file, parsed_file, formated_file, source_file) AS display_file FROM a""")
def _(t):
    return cat.artefact_inventory(t.artifacts)


@query("request_limit_violations", """
WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS profile_id, CASE WHEN turn = 3 THEN ''
  ELSE text END AS text, CASE conv_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'xx' END AS language, turn - 1 AS seed,
  CASE WHEN conv_id % 3 = 0 THEN '2B' ELSE '1B' END AS model_size, CASE WHEN conv_id % 6 = 0 THEN text END AS instruct,
  CASE WHEN conv_id % 7 = 0 THEN 'espeak' ELSE 'kokoro' END AS engine, 90 + conv_id AS max_chunk_chars,
  turn * 120 AS crossfade_ms FROM conversations)
SELECT conv_id, turn, concat_ws(',', CASE WHEN profile_id IS NULL THEN 'profile_id:required' END,
  CASE WHEN length(text) < 1 THEN 'text:min_length' END, CASE WHEN length(text) > 50000 THEN 'text:max_length' END,
  CASE WHEN language = 'xx' THEN 'language:allowed' END, CASE WHEN seed < 0 THEN 'seed:low' END,
  CASE WHEN model_size = '2B' THEN 'model_size:allowed' END, CASE WHEN length(instruct) > 500 THEN
  'instruct:max_length' END, CASE WHEN engine = 'espeak' THEN 'engine:allowed' END, CASE WHEN max_chunk_chars < 100 THEN
  'max_chunk_chars:low' END, CASE WHEN max_chunk_chars > 5000 THEN 'max_chunk_chars:high' END, CASE WHEN crossfade_ms > 500
  THEN 'crossfade_ms:high' END) AS violations FROM r""")
def _(t):
    r = t.conversations.selectExpr(
        "conv_id", "turn", "CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS profile_id",
        "CASE WHEN turn = 3 THEN '' ELSE text END AS text",
        "CASE conv_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'xx' END AS language", "turn - 1 AS seed",
        "CASE WHEN conv_id % 3 = 0 THEN '2B' ELSE '1B' END AS model_size",
        "CASE WHEN conv_id % 6 = 0 THEN text END AS instruct",
        "CASE WHEN conv_id % 7 = 0 THEN 'espeak' ELSE 'kokoro' END AS engine", "90 + conv_id AS max_chunk_chars",
        "turn * 120 AS crossfade_ms")
    return r.select("conv_id", "turn", F.array_join(val.violations(val.GENERATION_LIMITS), ",").alias("violations"))


_CHAIN_CASES = ("CASE event_id % 9 WHEN 0 THEN 'robot' WHEN 1 THEN 'gain' WHEN 2 THEN 'delay' ELSE 'reverb' END",
                "CASE event_id % 5 WHEN 0 THEN 'mix' WHEN 1 THEN 'gain_db' ELSE 'room_size' END",
                "CASE WHEN event_id % 11 = 0 THEN '\"loud\"' ELSE CAST(value / 100 AS STRING) END")


def _chains(t):
    kind, param, value = _CHAIN_CASES
    return t.events.selectExpr("event_id", f"""array(
        named_struct('type', 'lowpass', 'enabled', event_id % 2 = 0, 'params', map('cutoff_frequency_hz', '500')),
        named_struct('type', {kind}, 'enabled', true, 'params', map({param}, {value}))) AS chain""")


@query("effects_chain_errors", f"""
WITH c AS (SELECT event_id, {_CHAIN_CASES[0]} AS kind, {_CHAIN_CASES[1]} AS param, CASE WHEN event_id % 11 = 0 THEN NULL
  ELSE value / 100 END AS v, value FROM events),
r AS (SELECT * FROM (VALUES ('gain', 'gain_db', -40.0, 40.0), ('delay', 'mix', 0.0, 1.0), ('reverb', 'room_size', 0.0, 1.0))
  x(kind, param, lo, hi))
SELECT event_id, CASE WHEN c.kind = 'robot' THEN 'unknown type' WHEN r.kind IS NULL THEN 'unknown param'
  WHEN v IS NULL THEN 'not a number' WHEN v < lo OR v > hi THEN 'out of range' END AS problem
FROM c LEFT JOIN r ON r.kind = c.kind AND r.param = c.param""")
def _(t):
    error = val.chain_error(F.col("chain"))
    return _chains(t).select("event_id", error.alias("e")).select("event_id", F.when(
        F.col("e").startswith("Unknown effect type 'robot' at index 1"), "unknown type").when(
        F.col("e").contains("at index 1: unknown param"), "unknown param").when(
        F.col("e").contains("must be a number"), "not a number").when(
        F.col("e").contains("must be between"), "out of range").otherwise(F.col("e")).alias("problem"))


@query("effects_chain_defaults", f"""
WITH c AS (SELECT event_id, {_CHAIN_CASES[0]} AS kind, {_CHAIN_CASES[1]} AS param, CASE WHEN event_id % 11 = 0 THEN NULL
  ELSE value / 100 END AS v FROM events),
r AS (SELECT * FROM (VALUES ('gain', 'gain_db', 0.0), ('delay', 'delay_seconds', 0.3), ('delay', 'feedback', 0.3),
  ('delay', 'mix', 0.3), ('reverb', 'room_size', 0.5), ('reverb', 'damping', 0.5), ('reverb', 'wet_level', 0.33),
  ('reverb', 'dry_level', 0.4), ('reverb', 'width', 1.0)) x(kind, param, d))
SELECT event_id, 0 AS pos, 'lowpass' AS effect, 'cutoff_frequency_hz' AS param, CAST(500 AS DOUBLE) AS value FROM c
WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 1, c.kind, r.param, coalesce(CASE WHEN c.param = r.param THEN v END, CAST(d AS DOUBLE))
FROM c JOIN r ON r.kind = c.kind""")
def _(t):
    return val.effective_params(_chains(t), "event_id", "chain")


_RULES = """CASE c_custkey % 3 WHEN 0 THEN 'preset' WHEN 1 THEN 'designed' END AS voice_type,
CASE WHEN c_custkey % 6 = 0 THEN 'kokoro' WHEN c_custkey % 14 = 1 THEN 'tada' WHEN c_custkey % 15 = 9 THEN 'other' END AS
preset_engine, CASE WHEN c_custkey % 6 = 0 THEN concat('pv', c_custkey % 30) WHEN c_custkey % 15 = 9 THEN 'any' END
AS preset_voice_id, CASE WHEN c_custkey % 4 = 0 THEN ' ' WHEN c_custkey % 4 = 1 THEN 'a warm voice' END AS design_prompt,
CASE c_custkey % 5 WHEN 0 THEN 'qwen' WHEN 1 THEN 'kokoro' END AS default_engine"""


@query("profile_cross_field_rules", f"""
WITH p AS (SELECT c_custkey AS id, {_RULES} FROM customer), pv AS (SELECT DISTINCT 'kokoro' AS engine,
  concat('pv', s_suppkey % 12) AS voice_id FROM supplier)
SELECT id, CASE WHEN voice_type = 'preset' THEN CASE
  WHEN coalesce(preset_engine, '') = '' OR coalesce(preset_voice_id, '') = '' THEN
    'Preset profiles require both preset_engine and preset_voice_id'
  WHEN default_engine <> preset_engine THEN 'Preset profiles must use their preset_engine as default_engine'
  WHEN preset_engine = 'kokoro' AND preset_voice_id NOT IN (SELECT voice_id FROM pv) THEN
    concat('Preset voice ''', preset_voice_id, ''' is not valid for engine ''', preset_engine, '''') END
WHEN voice_type = 'designed' THEN CASE WHEN trim(coalesce(design_prompt, '')) = '' THEN
    'Designed profiles require a design_prompt' WHEN preset_engine IS NOT NULL OR preset_voice_id IS NOT NULL THEN
    'Designed profiles cannot set preset_engine or preset_voice_id' END
ELSE CASE WHEN preset_engine IS NOT NULL OR preset_voice_id IS NOT NULL THEN
    'Cloned profiles cannot set preset_engine or preset_voice_id' WHEN design_prompt <> '' THEN
    'Cloned profiles cannot set design_prompt' WHEN default_engine NOT IN
    ('qwen', 'luxtts', 'chatterbox', 'chatterbox_turbo', 'tada') THEN
    concat('Cloned profiles cannot use default engine ''', default_engine, '''') END END AS error FROM p""")
def _(t):
    profiles = t.customer.selectExpr("c_custkey AS id", *[_one.strip() for _one in _split_columns(_RULES)])
    preset = t.supplier.selectExpr("'kokoro' AS engine", "concat('pv', s_suppkey % 12) AS voice_id")
    return val.profile_error(profiles, preset).select("id", "error")


_PROFILE = ["c_custkey AS id",
            "CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 101) WHEN 2 THEN NULL ELSE c_name END AS name",
            "repeat('d', CAST(495 + c_custkey % 10 AS INT)) AS description",
            "CASE c_custkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'xx' END AS language",
            "CASE c_custkey % 5 WHEN 0 THEN 'cloned' WHEN 1 THEN 'preset' WHEN 2 THEN 'borrowed' WHEN 3 THEN 'designed' END "
            "AS voice_type",
            "repeat('e', CAST(46 + c_custkey % 9 AS INT)) AS preset_engine",
            "concat(c_name, repeat('v', CAST(c_custkey % 100 AS INT))) AS preset_voice_id",
            "repeat(c_name, CAST(c_custkey % 140 AS INT)) AS design_prompt",
            "CASE WHEN c_custkey % 2 = 0 THEN repeat(c_name, 3) END AS default_engine",
            "repeat(concat(c_name, ' '), CAST(c_custkey % 130 AS INT)) AS personality"]


@query("profile_limit_violations", f"""
WITH p AS (SELECT {', '.join(_PROFILE)} FROM customer)
SELECT id, concat_ws(',', CASE WHEN name IS NULL THEN 'name:required' END, CASE WHEN length(name) < 1 THEN 'name:min_length' END,
  CASE WHEN length(name) > 100 THEN 'name:max_length' END, CASE WHEN length(description) > 500 THEN 'description:max_length' END,
  CASE WHEN language = 'xx' THEN 'language:allowed' END,
  CASE WHEN voice_type = 'borrowed' THEN 'voice_type:allowed' END,
  CASE WHEN length(preset_engine) > 50 THEN 'preset_engine:max_length' END,
  CASE WHEN length(preset_voice_id) > 100 THEN 'preset_voice_id:max_length' END,
  CASE WHEN length(design_prompt) > 2000 THEN 'design_prompt:max_length' END,
  CASE WHEN length(default_engine) > 50 THEN 'default_engine:max_length' END,
  CASE WHEN length(personality) > 2000 THEN 'personality:max_length' END) AS violations FROM p""")
def _(t):
    p = t.customer.selectExpr(*_PROFILE)
    return p.select("id", F.array_join(val.violations(val.PROFILE_LIMITS), ",").alias("violations"))


@query("sample_text_violations", """
SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 7 = 1 THEN 'reference_text:required' END, CASE WHEN turn % 7 = 2 THEN
  'reference_text:min_length' END, CASE WHEN turn % 7 NOT IN (1, 2) AND length(text) > 1000 THEN 'reference_text:max_length' END)
  AS violations FROM conversations""")
def _(t):
    r = t.conversations.selectExpr("conv_id", "turn", "CASE turn % 7 WHEN 1 THEN NULL WHEN 2 THEN '' ELSE text END AS reference_text")
    return r.select("conv_id", "turn", F.array_join(val.violations(val.SAMPLE_LIMITS), ",").alias("violations"))


@query("page_limit_violations", """
SELECT event_id, concat_ws(',', CASE WHEN user_id % 120 < 1 THEN 'limit:low' WHEN user_id % 120 > 100 THEN 'limit:high' END,
  CASE WHEN event_id % 9 - 1 < 0 THEN 'offset:low' END) AS violations FROM events""")
def _(t):
    pages = t.events.selectExpr("event_id", "user_id % 120 AS limit", "event_id % 9 - 1 AS offset")
    return pages.select("event_id", F.array_join(val.violations(val.HISTORY_PAGE_LIMITS), ",").alias("violations"))


@query("volume_limit_violations", ctes("items") + """
SELECT id, CASE WHEN (trim_start_ms - 100) / 300 < 0 THEN 'volume:low' WHEN (trim_start_ms - 100) / 300 > 2 THEN 'volume:high'
  ELSE '' END AS violations FROM items""")
def _(t):
    scaled = t.items.select("id", ((F.col("trim_start_ms") - 100) / 300).alias("volume"))
    return scaled.select("id", F.array_join(val.violations(val.VOLUME_LIMITS), ",").alias("violations"))


@query("profile_engine_check", f"""
WITH p AS (SELECT c_custkey AS id, c_mktsegment, {_RULES} FROM customer),
r AS (SELECT *, CASE WHEN c_mktsegment LIKE 'B%' THEN 'kokoro' ELSE 'qwen' END AS engine FROM p)
SELECT id, engine, CASE WHEN voice_type = 'preset' THEN CASE WHEN coalesce(preset_engine, '') = '' OR
  coalesce(preset_voice_id, '') = '' THEN 'missing preset engine' WHEN preset_engine <> engine THEN 'other engine' END
  WHEN voice_type = 'designed' THEN CASE WHEN trim(coalesce(design_prompt, '')) = '' THEN 'missing design prompt' END
  WHEN engine NOT IN ('qwen', 'luxtts', 'chatterbox', 'chatterbox_turbo', 'tada') THEN 'engine cannot clone' END AS error
FROM r""")
def _(t):
    profiles = t.customer.selectExpr("c_custkey AS id", *[_one.strip() for _one in _split_columns(_RULES)],
                                     "CASE WHEN c_mktsegment LIKE 'B%' THEN 'kokoro' ELSE 'qwen' END AS engine")
    error = val.engine_error(*[F.col(c) for c in ("voice_type", "preset_engine", "preset_voice_id", "design_prompt",
                                                  "engine")])
    return profiles.select("id", "engine", error.alias("error"))


def _split_columns(text: str) -> list[str]:
    """Cut a projection list at the commas outside brackets."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]
