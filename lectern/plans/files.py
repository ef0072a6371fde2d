"""File sources and sinks."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import chunking as ch
from lectern.plans.chunks import _pack_cte, strict_cte
from lectern.plans.domain import ctes
from lectern.plans.registry import ORACLES, query
from lectern.session import scratch_path
from lectern.sources import projects as pj
from lectern.streaming import jobs
from lectern.streaming.runner import drain

_PATHS = ("concat('/data/p', conv_id, '/audio/seg', CASE WHEN turn = 6 THEN 'abcde' ELSE lpad(CAST(turn + 1 AS STRING), 5, "
          "'0') END, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN concat('_v', conv_id % 13) WHEN 2 THEN '_vx' ELSE '_v2' END, "
          "CASE WHEN conv_id % 9 = 8 THEN '.mp3' ELSE '.wav' END)")


@query("take_listing", """
SELECT concat('p', conv_id) AS project, CAST(turn + 1 AS INT) AS num, CASE turn % 4 WHEN 0 THEN 'main' WHEN 1 THEN
  concat('v', conv_id % 13) WHEN 2 THEN 'vx' ELSE 'v2' END AS version, CASE turn % 4 WHEN 1 THEN conv_id % 13 WHEN 3 THEN 2
  ELSE 0 END AS k FROM conversations WHERE turn <> 6 AND conv_id % 9 <> 8""")
def _(t):
    return pj.takes_from_paths(t.conversations.selectExpr(f"{_PATHS} AS path")).select("project", "num", "version", "k")


_SEG = "concat('seg', lpad(CAST(turn * 3 + 1 AS STRING), 5, '0')"


def _json_files(t):
    """One JSON file per turn of the even conversations, as projects with a name that needs encoding keep them."""
    body = F.to_json(F.struct(F.upper("role").alias("profile_id"), "text", (F.col("turn") / 8).alias("qc_score"),
                              F.expr("IF(turn % 4 = 0, NULL, CAST(turn % 2 AS INT))").alias("read")))
    return t.conversations.filter("conv_id % 2 = 0").select(
        F.expr(f"concat('p ', conv_id, '/tts/', {_SEG}, '.json'))").alias("path"), body.alias("content"))


def _text_files(t):
    """Older projects keep texts; some conversations have both forms."""
    return t.conversations.filter("conv_id % 3 <> 0").select(
        F.expr(f"concat('p ', conv_id, '/book/', {_SEG}, '.txt'))").alias("path"),
        F.concat(F.lit(" "), "text", F.lit("\n")).alias("content"))


@query("segment_files", """
SELECT concat('p ', conv_id) AS project, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS num,
  upper(role) AS profile_id, text, turn / 8::DOUBLE AS qc_score, CASE WHEN turn % 4 <> 0 THEN CAST(turn % 2 AS INT) END AS read
FROM conversations WHERE conv_id % 2 = 0""")
def _(t):
    root = scratch_path(t.spark, "projects")
    pj.write_files(_json_files(t), root)
    return pj.read_segments(t.spark, root).select("project", "num", "profile_id", "text", "qc_score", "read")


@query("legacy_segments", """
SELECT concat('p ', conv_id) AS project, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS num,
  CASE WHEN conv_id % 2 = 0 THEN upper(role) ELSE 'Narrator' END AS profile_id,
  CASE WHEN conv_id % 2 = 0 THEN text ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS text
FROM conversations WHERE conv_id % 2 = 0 OR conv_id % 3 <> 0""")
def _(t):
    root = scratch_path(t.spark, "projects")
    pj.write_files(_json_files(t).unionByName(_text_files(t)), root)
    return pj.project_segments(pj.read_segments(t.spark, root), pj.read_legacy_segments(t.spark, root)).select(
        "project", "num", "profile_id", "text")


@query("take_files", """
SELECT concat('p', conv_id) AS project, CAST(turn + 1 AS INT) AS num, CASE turn % 4 WHEN 0 THEN 'main' WHEN 1 THEN
  concat('v', conv_id % 13) WHEN 2 THEN 'vx' ELSE 'v2' END AS version, CASE turn % 4 WHEN 1 THEN conv_id % 13 WHEN 3 THEN 2
  ELSE 0 END AS k, strlen(role) AS size FROM conversations WHERE turn <> 6 AND conv_id % 9 <> 8""")
def _(t):
    root = scratch_path(t.spark, "takes")
    pj.write_files(t.conversations.selectExpr(f"substr({_PATHS}, 7) AS path", "role AS content"), root)
    return pj.takes_from_paths(pj.list_files(t.spark, f"{root}/*/audio")).select("project", "num", "version", "k", "size")


@query("file_increments", """
SELECT concat('seg', conv_id, '.json') AS name, string_agg(text, ' ' ORDER BY turn) AS text, CASE WHEN conv_id % 4 = 3 THEN 'new'
  WHEN conv_id % 4 = 2 THEN 'changed' ELSE 'old' END AS state FROM conversations GROUP BY conv_id""")
def _(t):
    """Files of all conversations: three in four at first, then the others and changes to a third of the first.

    A stream with its checkpoint reads new files only, the times of the files lead to the changed ones.
    """
    turn = F.sort_array(F.collect_list(F.struct("turn", "text")))
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turn, lambda x: x["text"]), " ").alias("text"))
    files = lambda rows, text: rows.select(
        F.expr("concat('seg', conv_id, '.json')").alias("path"), F.to_json(F.struct(text.alias("text"))).alias("content"))
    root, out, check = (scratch_path(t.spark, n) for n in ("files", "read", "seen"))
    pj.write_files(files(whole.filter("conv_id % 4 <> 3"), F.when(F.expr("conv_id % 4 = 2"), "draft").otherwise(F.col("text"))), root)
    stream = lambda: jobs.file_increments(
        t.spark.readStream.schema("text string").option("maxFilesPerTrigger", 1_000_000).json(root))
    since = drain(stream(), "append", out, check).agg(F.max("mtime").alias("m")).first()["m"]
    time.sleep(1.1)  # some stores keep whole seconds
    pj.write_files(files(whole.filter("conv_id % 4 > 1"), F.col("text")), root)
    streamed = drain(stream(), "append", out, check)
    name = lambda path: F.regexp_extract(path, r"([^/]+)$", 1).alias("name")
    first = streamed.filter("batch_id = 0").select(name(F.col("file")), "text")
    new = streamed.filter("batch_id > 0").select(name(F.col("file")), "text", F.lit("new").alias("state"))
    late = pj.modified_since(t.spark.read.schema("text string").json(root), F.lit(since)).select(name(F.col("path")), "text")
    changed = late.join(new, "name", "left_anti").withColumn("state", F.lit("changed"))
    old = first.join(late, "name", "left_anti").withColumn("state", F.lit("old"))
    return old.unionByName(changed).unionByName(new)


def _le(n: str, width: int) -> str:
    """Little-endian hex of an integer expression."""
    padded = f"lpad(hex({n}), {width * 2}, '0')"
    return "concat(" + ", ".join(f"substr({padded}, {2 * k + 1}, 2)" for k in reversed(range(width))) + ")"


@query("audio_header_durations", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey * 1000 AS DOUBLE) /
  (CASE WHEN o_orderkey % 2 = 0 THEN 24000 ELSE 16000 END * (1 + o_orderkey % 2) * 2) END AS duration FROM orders""")
def _(t):
    rate, channels = "CASE WHEN o_orderkey % 2 = 0 THEN 24000 ELSE 16000 END", "1 + o_orderkey % 2"
    head = (f"concat(CASE WHEN o_orderkey % 10 = 0 THEN '49443303' ELSE '52494646' END, {_le('36', 4)}, '57415645', "
            # a chunk of another kind first, then the format, then the data
            f"'4C495354', {_le('4', 4)}, '00000000', '666D7420', {_le('16', 4)}, {_le('1', 2)}, {_le(channels, 2)}, "
            f"{_le(rate, 4)}, {_le('0', 4)}, {_le('0', 2)}, {_le('16', 2)}, '64617461', {_le('o_custkey * 1000', 4)})")
    return pj.audio_durations(t.orders.selectExpr("o_orderkey AS id", f"unhex({head}) AS content"))


@query("json_threshold_rows", """
SELECT concat('vp-', p_partkey) AS voice_id, b.bucket, CAST(p_size AS DOUBLE) + b.d AS pct FROM part,
  (VALUES ('0.5', 0), ('10', 1)) b(bucket, d)""")
def _(t):
    text = F.to_json(F.create_map(F.concat(F.lit("vp-"), F.col("p_partkey").cast("string")), F.create_map(
        F.lit("0.5"), F.col("p_size"), F.lit("10"), F.col("p_size") + 1)))
    return pj.threshold_rows(t.part.select(text.alias("j")), "j")


@query("json_name_rows", "SELECT p_name AS name, concat('vp-', p_partkey) AS voice_id FROM part")
def _(t):
    text = F.to_json(F.create_map("p_name", F.concat(F.lit("vp-"), F.col("p_partkey").cast("string"))))
    return pj.name_rows(t.part.select(text.alias("j")), "j")


# The references that the given pages hold, and some more; `&amp;` comes last.
_REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"),
               ("&middot;", "·"), ("&laquo;", "«"), ("&raquo;", "»"), ("&hellip;", "…"), ("&mdash;", "—"),
               ("&ndash;", "–"), ("&rsquo;", "’"), ("&eacute;", "é"), ("&Agrave;", "À"), ("&#x2019;", "’"), ("&amp;", "&"))
_DECODE = "x"
for _name, _sign in _REFERENCES:
    _DECODE = f"replace({_DECODE}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query("markup_blocks", f"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', chr(1), 'g'),
  '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', chr(1), 'g'), '<![^>]*>', chr(1), 'g') AS h FROM pages),
t AS (SELECT page_id, 0 AS k, 'TITLE' AS kind, '=== ' || trim(regexp_replace({_DECODE.replace('x', "regexp_replace(x, '<[^>]*>', ' ', 'g')", 1)}, '\\s+', ' ', 'g')) || ' ===' AS text
  FROM (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)) AS x FROM b)),
w AS (SELECT page_id, 1 AS k, 'TEXT' AS kind, trim(regexp_replace({_DECODE.replace('x', "regexp_replace(replace(h, chr(1), ' '), '<[^>]*>', ' ', 'g')", 1)}, '[\\s\\x{{A0}}]+', ' ', 'g')) AS text FROM b),
u AS (SELECT * FROM t UNION ALL SELECT * FROM w)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS block_no, kind, text FROM u
WHERE text <> ''""")
def _(t):
    return pj.markup_blocks(t.pages, "page_id", "html")


@query("markup_to_smart_lines", f"""WITH RECURSIVE mb AS ({ORACLES['markup_blocks']}),
tx AS (SELECT page_id * 1000 + block_no AS k, text FROM mb WHERE kind = 'TEXT'),
{strict_cte('tx', 'k').replace(' p AS', ' pp AS')}, {_pack_cte(220, key='k')},
c AS (SELECT w.k, w.g, string_agg(s.x, ' ' ORDER BY s.i) AS text FROM w JOIN s ON s.k = w.k AND s.i = w.i GROUP BY 1, 2)
SELECT k // 1000 AS page_id, CAST(k % 1000 AS INT) AS block_no, g AS chunk_no, text FROM c
UNION ALL SELECT page_id, block_no, 0, text FROM mb WHERE kind = 'TITLE'""")
def _(t):
    blocks = pj.markup_blocks(t.pages, "page_id", "html")
    cut = ch.pack(ch.sentences_strict(blocks, "text", "s"), "s", "lines", 220)
    lines = F.when(F.col("kind") == "TITLE", F.array("text")).otherwise(F.col("lines"))
    rows = cut.withColumn("lines", lines)
    return ch.explode_chunks(rows, ["page_id", "block_no"], "lines")


@query("segment_sink_roundtrip", ctes("segments") + """
SELECT project, num, concat('seg', lpad(CAST(num AS STRING), 5, '0')) AS segment_id, profile_id,
  CASE WHEN project % 2 = 0 THEN 'second' ELSE text END AS text FROM segments""")
def _(t):
    path = scratch_path(t.spark, "segments")
    segs = t.segments.select("project", "num", "profile_id", "text")
    pj.write_segments(segs, path)
    # A second run replaces the even projects only.
    pj.write_segments(segs.filter("project % 2 = 0").withColumn("text", F.lit("second")), path)
    return t.spark.read.schema(
        "project bigint, num int, profile_id string, text string, segment_id string").parquet(path).select(
        "num", "profile_id", "text", "segment_id", "project")


@query("chunk_sink_catalogue", """
SELECT source AS project, doc_id AS idx, CAST(length(text) AS INT) AS chars,
  left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 140) AS preview FROM documents""")
def _(t):
    chunks = t.documents.selectExpr("source AS project", "doc_id AS idx", "text")
    return pj.write_chunks(chunks, scratch_path(t.spark, "chunks")).select(
        F.col("project").cast("string").alias("project"), "idx", "chars", "preview")
