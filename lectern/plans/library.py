"""History, profiles and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import library as lib
from lectern.plans.domain import ctes
from lectern.plans.registry import query

_HIST = """h AS (SELECT g.id, g.profile_id, p.name AS profile_name, g.text, g.duration,
  coalesce(g.status, 'completed') AS status, coalesce(g.engine, 'qwen') AS engine, g.created_at
  FROM generations g JOIN profiles p ON g.profile_id = p.id)"""
_HCOLS = ["id", "profile_id", "profile_name", "text", "duration", "status", "engine", "created_at"]


@query("history_join", ctes("generations", "profiles") + f", {_HIST} SELECT * FROM h")
def _(t):
    return lib.history(t.generations, t.profiles).select(*_HCOLS)


@query("history_text_search", ctes("generations", "profiles") + f", {_HIST} SELECT * FROM h WHERE "
       "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%low%'")
def _(t):
    return lib.text_search(lib.history(t.generations, t.profiles).select(*_HCOLS), "text", "LOW")


@query("history_page", ctes("generations", "profiles") + f""", {_HIST}
SELECT id, profile_name, status, created_at, (SELECT count(*) FROM h) AS total
FROM h ORDER BY created_at DESC, id LIMIT 50 OFFSET 100""")
def _(t):
    rows = lib.history(t.generations, t.profiles).select("id", "profile_name", "status", "created_at")
    return lib.page_with_total(rows, [F.desc("created_at"), F.asc("id")], limit=50, offset=100)


_ORDER = [("created_at", True), ("id", False)]


@query("history_page_after", ctes("generations", "profiles") + f""", {_HIST}
SELECT id, profile_name, status, created_at FROM h WHERE created_at < '1995-06-17' OR created_at = '1995-06-17' AND id > 3000
ORDER BY created_at DESC, id LIMIT 50""")
def _(t):
    rows = lib.history(t.generations, t.profiles).select("id", "profile_name", "status", "created_at")
    key = (F.lit("1995-06-17").cast(rows.schema["created_at"].dataType), 3000)
    return lib.page_after(rows, _ORDER, key, limit=50)


@query("history_page_deep", ctes("generations", "profiles") + f""", {_HIST}
SELECT id, profile_name, status, created_at FROM h
ORDER BY created_at DESC, id LIMIT 50 OFFSET (SELECT count(*) * 7 // 10 FROM h)""")
def _(t):
    rows = lib.history(t.generations, t.profiles).select("id", "profile_name", "status", "created_at")
    return lib.page_at(rows, _ORDER, limit=50, offset=rows.count() * 7 // 10)


@query("voices_contains_search", ctes("profiles") + """SELECT id, name, description, language FROM profiles
WHERE contains(lower(coalesce(name,'')), '77') OR contains(lower(coalesce(description,'')), '77')
   OR contains(lower(coalesce(language,'')), '77')""")
def _(t):
    return lib.contains_search(t.profiles, ["name", "description", "language"], " 77 ").select(
        "id", "name", "description", "language")


@query("stories_contains_search", ctes("stories") + """SELECT * FROM stories
WHERE contains(lower(coalesce(name,'')), 'urgent') OR contains(lower(coalesce(description,'')), 'urgent')""")
def _(t):
    return lib.contains_search(t.stories, ["name", "description"], "Urgent")


@query("captures_contains_search", """SELECT conv_id, turn FROM conversations
WHERE contains(lower(text), 'ment') OR contains(lower(role), 'ment')""")
def _(t):
    return lib.contains_search(t.conversations, ["text", "role"], "Ment").select("conv_id", "turn")


@query("story_detail_join", ctes("items", "generations", "profiles") + f""", {_HIST}
SELECT i.id, i.story_id, i.generation_id, i.start_time_ms, h.profile_name, h.text, h.engine
FROM items i JOIN h ON i.generation_id = h.id""")
def _(t):
    return lib.story_detail(t.items, t.generations, t.profiles).select(
        "id", "story_id", "generation_id", "start_time_ms", "profile_name", "text", "engine")


@query("profile_usage_counts", ctes("profiles", "generations", "samples") + """
SELECT p.id AS profile_id, p.name,
  (SELECT count(*) FROM generations g WHERE g.profile_id = p.id) AS generation_count,
  (SELECT count(*) FROM samples s WHERE s.profile_id = p.id) AS sample_count FROM profiles p""")
def _(t):
    return lib.profile_counts(t.profiles, t.generations, t.samples).select(
        "profile_id", "name", "generation_count", "sample_count")


@query("pinned_version_audio", ctes("items", "generations", "versions") + """
SELECT i.id, i.version_id, coalesce(v.audio_path, g.audio_path) AS audio_path
FROM items i JOIN generations g ON i.generation_id = g.id LEFT JOIN versions v ON i.version_id = v.id""")
def _(t):
    return lib.resolved_audio(t.items, t.generations, t.versions).select("id", "version_id", "audio_path")


_TASKS = """tasks AS (SELECT event_type AS key, max(CASE WHEN user_id % 2 = 0 THEN 'failed' END) AS status,
  max(CASE WHEN user_id % 3 = 0 THEN concat('task error ', user_id % 3) END) AS error
  FROM events WHERE event_type <> 'view' GROUP BY 1),
prog AS (SELECT concat(event_type, CASE WHEN user_id % 2 = 0 THEN '' ELSE '-x' END) AS key,
  max(event_type) AS status, max(CASE WHEN event_type = 'error' THEN 'download error' END) AS error
  FROM events WHERE event_type <> 'click' GROUP BY 1)"""


def _task_tables(t):
    e = t.events
    tasks = e.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("key")).agg(
        F.max(F.when(F.col("user_id") % 2 == 0, "failed")).alias("status"),
        F.max(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("task error "), (F.col("user_id") % 3).cast("string"))))
        .alias("error"))
    prog = e.filter("event_type <> 'click'").groupBy(
        F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "").otherwise("-x")).alias("key")).agg(
        F.max("event_type").alias("status"),
        F.max(F.when(F.col("event_type") == "error", "download error")).alias("error"))
    return tasks, prog


@query("active_task_outer_join", f"""WITH {_TASKS}
SELECT coalesce(a.key, b.key) AS key, coalesce(a.status, b.status) AS status, coalesce(a.error, b.error) AS error
FROM tasks a FULL JOIN prog b ON a.key = b.key""")
def _(t):
    return lib.full_task_view(*_task_tables(t))


@query("task_key_union", f"WITH {_TASKS} SELECT key FROM tasks UNION SELECT key FROM prog")
def _(t):
    return lib.key_union(*_task_tables(t), "key")


@query("generations_outside_stories", ctes("generations", "items") + """
SELECT id, text, duration FROM generations g WHERE coalesce(status,'completed') = 'completed'
AND contains(lower(text), 'urgent') AND NOT EXISTS (SELECT 1 FROM items i WHERE i.generation_id = g.id)""")
def _(t):
    return lib.available_for_story(t.generations, t.items, "urgent").select("id", "text", "duration")


@query("history_statistics", ctes("generations") + """
SELECT profile_id, count(*) AS generations, CAST(sum(CAST(duration AS DECIMAL(28,6))) AS DOUBLE) AS total_duration
FROM generations GROUP BY ROLLUP (profile_id)""")
def _(t):
    return lib.history_statistics(t.generations)


@query("stories_newest_first", ctes("stories", "items") + """
SELECT s.id, s.name, s.updated_at, count(i.id) AS item_count FROM stories s LEFT JOIN items i ON i.story_id = s.id
GROUP BY ALL ORDER BY updated_at DESC, s.id""")
def _(t):
    return lib.stories_with_counts(t.stories, t.items).select("id", "name", "updated_at", "item_count").orderBy(
        F.desc("updated_at"), "id")


@query("versions_in_order", ctes("versions") + """
SELECT id, generation_id, row_number() OVER (PARTITION BY generation_id ORDER BY created_at, id) AS ordinal,
  coalesce(id = last_value(CASE WHEN is_default THEN id END IGNORE NULLS) OVER (PARTITION BY generation_id
    ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), false) AS is_active
FROM versions""")
def _(t):
    return lib.ordered_versions(t.versions).select("id", "generation_id", "ordinal", "is_active")


@query("default_version_pick", ctes("versions") + """
SELECT generation_id, id AS version_id FROM versions
QUALIFY row_number() OVER (PARTITION BY generation_id ORDER BY NOT is_default, created_at, id) = 1""")
def _(t):
    return lib.default_version(t.versions)


@query("reprocess_source_version", ctes("generations", "versions") + """
, c AS (SELECT * FROM versions WHERE effects_chain IS NULL
  QUALIFY row_number() OVER (PARTITION BY generation_id ORDER BY created_at, id) = 1)
SELECT g.id AS generation_id, c.id AS version_id, coalesce(c.audio_path, g.audio_path) AS audio_path
FROM generations g LEFT JOIN c ON c.generation_id = g.id""")
def _(t):
    return lib.source_version(t.generations, t.versions)


@query("automatic_version_labels", ctes("versions") + """
, old AS (SELECT * FROM versions WHERE is_default), new AS (SELECT * FROM versions WHERE NOT is_default)
SELECT n.id, n.generation_id, concat('version-', coalesce(c.k, 0) +
  row_number() OVER (PARTITION BY n.generation_id ORDER BY n.created_at, n.id)) AS label
FROM new n LEFT JOIN (SELECT generation_id, count(*) AS k FROM old GROUP BY 1) c USING (generation_id)""")
def _(t):
    v = t.versions
    return lib.append_version_labels(v.filter("NOT is_default"), v.filter("is_default")).select(
        "id", "generation_id", "label")


@query("cascade_delete_failed", ctes("generations", "versions") + """
SELECT 'generation' AS kind, CAST(id AS VARCHAR) AS id FROM generations WHERE status <> 'failed'
UNION ALL SELECT 'version', v.id FROM versions v
WHERE v.generation_id NOT IN (SELECT id FROM generations WHERE status = 'failed')""")
def _(t):
    g, v = lib.drop_generations(t.generations, t.versions, F.col("status") == "failed")
    return g.select(F.lit("generation").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(
        v.select(F.lit("version").alias("kind"), "id"))


@query("cascade_delete_profile", ctes("generations", "versions") + """
SELECT 'generation' AS kind, CAST(id AS VARCHAR) AS id FROM generations WHERE profile_id <> 42
UNION ALL SELECT 'version', v.id FROM versions v
WHERE v.generation_id NOT IN (SELECT id FROM generations WHERE profile_id = 42)""")
def _(t):
    g, v = lib.drop_generations(t.generations, t.versions, F.col("profile_id") == 42)
    return g.select(F.lit("generation").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(
        v.select(F.lit("version").alias("kind"), "id"))


_CHOSEN = """, chosen AS (SELECT generation_id, max(id) AS version_id FROM versions
WHERE NOT is_default AND generation_id % 2 = 0 GROUP BY 1)"""


def _chosen(t):
    return t.versions.filter("NOT is_default AND generation_id % 2 = 0").groupBy("generation_id").agg(
        F.max("id").alias("version_id"))


@query("set_default_version", ctes("versions") + _CHOSEN + """
SELECT v.id, v.generation_id, CASE WHEN c.version_id IS NULL THEN v.is_default ELSE v.id = c.version_id END
  AS is_default FROM versions v LEFT JOIN chosen c USING (generation_id)""")
def _(t):
    return lib.set_default(t.versions, _chosen(t)).select("id", "generation_id", "is_default")


@query("default_version_paths", ctes("versions", "generations") + _CHOSEN + """
SELECT g.id, coalesce(v.audio_path, g.audio_path) AS audio_path FROM generations g
LEFT JOIN chosen c ON c.generation_id = g.id LEFT JOIN versions v ON v.id = c.version_id""")
def _(t):
    return lib.paths_after_default(t.generations, t.versions, _chosen(t)).select("id", "audio_path")


@query("promote_after_delete", ctes("versions") + """
, m AS (SELECT *, (label IN ('v1', 'v2') OR is_default) AS doomed FROM versions),
r AS (SELECT *, bool_and(doomed) OVER (PARTITION BY generation_id) AS all_doomed,
  row_number() OVER (PARTITION BY generation_id ORDER BY created_at, id) AS age,
  bool_or(is_default) OVER (PARTITION BY generation_id) AS had FROM m),
kept AS (SELECT * FROM r WHERE NOT doomed OR (all_doomed AND age = 1)),
k AS (SELECT *, bool_or(is_default AND NOT doomed) OVER (PARTITION BY generation_id) AS still,
  row_number() OVER (PARTITION BY generation_id ORDER BY created_at, id) AS n FROM kept)
SELECT id, generation_id, CASE WHEN had AND NOT still THEN n = 1 ELSE is_default END AS is_default FROM k""")
def _(t):
    doomed = t.versions.filter("label IN ('v1', 'v2') OR is_default").select("id")
    return lib.delete_versions(t.versions, doomed).select("id", "generation_id", "is_default")


@query("backfill_clean_versions", ctes("generations", "versions") + """
SELECT concat('clean-', g.id) AS id, g.id AS generation_id, 'clean' AS label, true AS is_default, g.created_at,
  g.audio_path FROM generations g WHERE coalesce(status, 'completed') = 'completed' AND audio_path <> ''
AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.generation_id = g.id)
AND audio_path IN (SELECT concat('generations/', l_partkey, '.wav') FROM lineitem)""")
def _(t):
    listing = t.lineitem.select(F.concat(F.lit("generations/"), F.col("l_partkey").cast("string"), F.lit(".wav"))
                                .alias("path"))
    return lib.backfill_versions(t.generations, t.versions, listing)


@query("toggle_favourites", ctes("generations") + """
SELECT id, CASE WHEN id IN (SELECT l_partkey FROM lineitem) THEN NOT is_favorited ELSE is_favorited END AS is_favorited
FROM generations""")
def _(t):
    return lib.toggle(t.generations, t.lineitem.select(F.col("l_partkey").alias("id")), "is_favorited").select(
        "id", "is_favorited")


@query("duplicate_profile_names", "SELECT p_name AS name, count(*) AS holders FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return lib.duplicate_names(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("profile_name_conflicts", ctes("profiles") + """
SELECT u.id, u.name, p.id AS other_id FROM (SELECT s_suppkey AS id,
  concat('Customer#', lpad(CAST(s_suppkey * 2 AS STRING), 9, '0')) AS name FROM supplier) u
JOIN profiles p ON p.name = u.name WHERE p.id <> u.id""")
def _(t):
    updates = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(
        F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0")).alias("name"))
    return lib.name_conflicts(updates, t.profiles)


@query("bulk_import_names", """
WITH u AS (SELECT DISTINCT p_name AS base, CAST(p_size AS BIGINT) AS k FROM part),
w AS (SELECT p_partkey AS ord, p_name AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part),
free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS r FROM (SELECT base,
  unnest(range(0, n + 60)) AS k FROM (SELECT p_name AS base, count(*) AS n FROM part GROUP BY 1)) x
  WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.base = x.base AND u.k = x.k))
SELECT w.ord, CASE WHEN f.k = 0 THEN w.base ELSE concat(w.base, ' (', f.k, ')') END AS name
FROM w JOIN free f ON f.base = w.base AND f.r = w.r""")
def _(t):
    wanted = t.part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    taken = t.part.select(F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")).alias("name"))
    return lib.import_names(wanted, taken)


_MAP = """WITH m AS (SELECT DISTINCT s_nationkey AS channel_id, s_suppkey AS profile_id FROM supplier),
ch AS (SELECT c_nationkey AS channel_id, c_custkey AS profile_id FROM customer WHERE c_acctbal < 3000),
known AS (SELECT s_suppkey * 3 AS profile_id FROM supplier UNION SELECT c_custkey FROM customer WHERE c_nationkey < 12),
bad AS (SELECT channel_id FROM ch WHERE profile_id NOT IN (SELECT profile_id FROM known)),
ok AS (SELECT DISTINCT * FROM ch WHERE channel_id NOT IN (SELECT channel_id FROM bad))
SELECT * FROM m WHERE channel_id NOT IN (SELECT channel_id FROM ok) UNION ALL SELECT * FROM ok"""


@query("replace_channel_mappings", _MAP)
def _(t):
    mappings = t.supplier.select(F.col("s_nationkey").alias("channel_id"), F.col("s_suppkey").alias("profile_id"))
    changes = t.customer.filter("c_acctbal < 3000").select(
        F.col("c_nationkey").alias("channel_id"), F.col("c_custkey").alias("profile_id"))
    known = t.supplier.select((F.col("s_suppkey") * 3).alias("profile_id")).union(
        t.customer.filter("c_nationkey < 12").select("c_custkey"))
    return lib.replace_mappings(mappings.distinct(), changes, "channel_id", "profile_id", known)


@query("default_channel_mapping", "SELECT 1 AS channel_id, c_custkey AS profile_id FROM customer")
def _(t):
    return lib.default_mapping(t.profiles, 1)


@query("import_under_singleton", ctes("profiles") + """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(-1 AS BIGINT) AS profile_id, 'import' AS source FROM documents
UNION ALL SELECT CAST(id AS VARCHAR), id, 'profile' FROM profiles UNION ALL SELECT '-1', -1, 'profile'
WHERE NOT EXISTS (SELECT 1 FROM profiles WHERE name = 'Imported audio')""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    fresh, grown = lib.adopt_imports(rows, t.profiles, -1, "Imported audio")
    return fresh.select(F.col("id").cast("string").alias("id"), "profile_id", "source").unionByName(
        grown.select(F.col("id").cast("string").alias("id"), F.col("id").alias("profile_id"),
                     F.lit("profile").alias("source")))


@query("merge_history_pages", ctes("generations") + """
, pages AS (SELECT 1 AS page, id AS ord, id, text FROM generations WHERE id % 3 <> 0
  UNION ALL SELECT 2, id, id, upper(text) FROM generations WHERE id % 2 = 0)
SELECT id, page, text FROM pages QUALIFY row_number() OVER (PARTITION BY id ORDER BY page, ord) = 1""")
def _(t):
    g = t.generations
    first = g.filter("id % 3 <> 0").select(F.lit(1).alias("page"), F.col("id").alias("ord"), "id", "text")
    second = g.filter("id % 2 = 0").select(F.lit(2).alias("page"), F.col("id").alias("ord"), "id",
                                           F.upper("text").alias("text"))
    return lib.merge_pages(first.unionByName(second), ["page", "ord"]).select("id", "page", "text")


@query("client_last_seen", ctes("requests") + """
SELECT client_id, max(ts) AS last_seen_at FROM requests WHERE path IN ('/mcp', '/speak') OR path LIKE '/mcp/%'
OR path LIKE '/speak/%' GROUP BY 1""")
def _(t):
    return lib.last_seen(t.requests)


@query("voice_precedence", ctes("requests", "profiles", "clients") + """
SELECT r.event_id, r.client_id, r.explicit_voice, CASE WHEN r.explicit_voice IS NOT NULL THEN
  coalesce((SELECT min(id) FROM profiles p WHERE CAST(p.id AS VARCHAR) = r.explicit_voice),
           (SELECT min(id) FROM profiles p WHERE lower(p.name) = lower(r.explicit_voice)))
  ELSE coalesce((SELECT min(c.profile_id) FROM clients c JOIN profiles p ON p.id = c.profile_id
     WHERE c.client_id = r.client_id), 7) END AS resolved_profile
FROM requests r""")
def _(t):
    return lib.resolve_voice(t.requests, t.profiles, t.clients, 7).select(
        "event_id", "client_id", "explicit_voice", "resolved_profile")


@query("retranscription_reset", """
SELECT a.conv_id * 100 + a.turn AS id, coalesce(b.text, a.text) AS transcript_raw,
  CASE WHEN b.text IS NULL THEN lower(a.text) END AS transcript_refined
FROM conversations a LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') b
  ON b.conv_id = a.conv_id AND b.turn = a.turn""")
def _(t):
    c = t.conversations.withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    captures = c.select("id", F.col("text").alias("transcript_raw"), F.lower("text").alias("transcript_refined"))
    again = c.filter("role = 'assistant'").select("id", F.col("text").alias("transcript_raw"))
    return lib.invalidate_refined(captures, again)


@query("refinement_flag_columns", """
SELECT event_id, event_type <> 'error' AS smart_cleanup, true AS self_correction, event_type <> 'view' AS
preserve_technical FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "error", F.lit('{"smart_cleanup": false}')).when(
        F.col("event_type") == "view", F.lit('{"preserve_technical": false, "self_correction": true}')).when(
        F.col("event_type") == "click", F.lit("")).otherwise(F.col("props"))
    return lib.refinement_flags(t.events.select("event_id", text.alias("refinement_flags"))).drop("refinement_flags")


@query("storage_path_rewrite", ctes("generations") + """
, p AS (SELECT id, CASE WHEN id % 3 = 0 THEN concat('/data/voice/', audio_path) ELSE audio_path END AS audio_path
  FROM generations)
SELECT id, substr(audio_path, 13) AS audio_path, audio_path AS old_path FROM p WHERE audio_path LIKE '/data/voice/%'""")
def _(t):
    moved = t.generations.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("/data/voice/"), "audio_path"))
                                 .otherwise(F.col("audio_path")).alias("audio_path"))
    return lib.relative_paths(moved, "audio_path", "/data/voice")


@query("relational_source_defaults", ctes("generations") + """
SELECT id, coalesce(engine, 'qwen') AS engine, coalesce(status, 'completed') AS status, created_at FROM generations""")
def _(t):
    return lib.with_history_defaults(t.generations).select("id", "engine", "status", "created_at")
