"""Line rules, page numbers, paragraphs and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows
from lectern.operators import corpus
from lectern.plans.domain import ctes
from lectern.plans.registry import query


def lines_cte(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """`l(key, i, x)`: the lines of each text, numbered from 1."""
    return (f"l AS (SELECT {key}, i, a[i] AS x FROM (SELECT {key}, a, unnest(range(1, len(a) + 1)) AS i FROM "
            f"(SELECT {key}, string_split({text}, chr(10)) AS a FROM {source})) "
            "WHERE NOT (a[i] = '' AND i = len(a)))")


RULES = [
    tx.Rule("/([A-Za-z]+)tion/i", "$1-TION"),
    tx.Rule(r"/ \| /", "\\n"),
    tx.Rule("(", "["),
    tx.Rule("e", "E", active=False),
    tx.Rule("[broken", "fixed"),
    tx.Rule("/[unclosed/", "never"),
    tx.Rule("/[0-9]{3,}/", ""),
    tx.Rule("%%%|&&&|###", ""),
    tx.Rule("{", "<"),
    tx.Rule("/[[]{1}/", "("),
    tx.Rule("/[$&&$]/", "§"),
    tx.Rule("/(a)?(?(1)b|c)/", "never"),
]
_R = ("regexp_replace(replace(replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '(?i)([A-Za-z]+)tion', "
      "'\\1-TION', 'g'), ' \\| ', chr(10), 'g'), '(', '['), '[broken', 'fixed'), '[0-9]{3,}', '', 'g'), "
      "'%%%|&&&|###', '', 'g'), '{', '<'), '[', '('), '[$&]', '§', 'g')")


@query("line_rules", f"""WITH {lines_cte()}, r AS (SELECT doc_id, i, x, {_R} AS y FROM l),
k AS (SELECT * FROM r WHERE NOT (trim(x) <> '' AND trim(y, ' ' || chr(10)) = '')),
s AS (SELECT doc_id, i, y, b, unnest(range(1, len(b) + 1)) AS j FROM (SELECT *, string_split(y, chr(10)) AS b FROM k))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INT) AS line_no, b[j] AS line FROM s
WHERE NOT (b[j] = '' AND j = len(b) AND y <> '')""")
def _(t):
    return corpus.normalised_lines(t.documents, RULES)


_NUMBERED = "replace(replace(text, ', ', concat(chr(10), n_chars, chr(10), '- 12 -', chr(10), 'Page 7', chr(10))), " \
            "' de ', concat(chr(10), '12. fin', chr(10), ' 7 ', chr(10)))"
_NUMBERED_SPARK = "replace(replace(text, ', ', concat('\\n', n_chars, '\\n- 12 -\\nPage 7\\n')), ' de ', " \
                  "'\\n12. fin\\n 7 \\n')"


def _numbered(t):
    return t.documents.selectExpr("doc_id", f"{_NUMBERED_SPARK} AS text")


@query("page_numbers_prose", f"""WITH d AS (SELECT doc_id, {_NUMBERED} AS text FROM documents), {lines_cte('d')}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, x AS line FROM l
WHERE NOT regexp_matches(trim(x), '^[-–—]?\\s*[0-9]+\\s*[-–—]?$')
  AND NOT regexp_matches(lower(trim(x)), '^(page|p\\.)\\s*[0-9]+$')""")
def _(t):
    kept = tx.drop_page_numbers(tx.lines(F.col("text")), tx.PAGE_NUMBER_PROSE)
    return numbered_rows(_numbered(t), ["doc_id"], kept, "line_no", "line")


@query("page_numbers_play", f"""WITH d AS (SELECT doc_id, {_NUMBERED} AS text FROM documents), {lines_cte('d')}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, x AS line FROM l
WHERE NOT regexp_matches(trim(x), '^[0-9]+$') AND NOT regexp_matches(trim(x), '^[0-9]+\\.\\s+.*$')""")
def _(t):
    kept = tx.drop_page_numbers(tx.lines(F.col("text")), tx.PAGE_NUMBER_PLAY)
    return numbered_rows(_numbered(t), ["doc_id"], kept, "line_no", "line")


_SPACED = "replace(text, '. ', concat('.', chr(10), chr(10), chr(10), ' ', chr(10)))"


@query("blank_line_collapse", f"""WITH d AS (SELECT doc_id, {_SPACED} AS text FROM documents), {lines_cte('d')},
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, x AS line FROM p
WHERE NOT (x = '' AND before IS NOT NULL AND before = '')""")
def _(t):
    spaced = t.documents.selectExpr("doc_id", "replace(text, '. ', '.\\n\\n\\n \\n') AS text")
    return numbered_rows(spaced, ["doc_id"], tx.collapse_blank_lines(tx.lines(F.col("text"))), "line_no", "line")


@query("blank_line_collapse_loose", f"""WITH d AS (SELECT doc_id, {_SPACED} AS text FROM documents), {lines_cte('d')},
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, x AS line FROM p
WHERE NOT (trim(x) = '' AND (before IS NULL OR trim(before) = ''))""")
def _(t):
    spaced = t.documents.selectExpr("doc_id", "replace(text, '. ', '.\\n\\n\\n \\n') AS text")
    return numbered_rows(spaced, ["doc_id"], tx.collapse_blank_lines_loose(tx.lines(F.col("text"))), "line_no", "line")


@query("dehyphenate_paragraphs", """
WITH d AS (SELECT doc_id, replace(replace(text, 'ti', concat('t-', chr(10), 'i')), '. ', concat('.  ', chr(10), chr(10)))
  AS text FROM documents),
h AS (SELECT doc_id, regexp_replace(text, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g') AS text FROM d),
p AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM
  (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS a FROM h)),
c AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(a[i], '\\s*\\n\\s*', ' ', 'g'), '[ \\t]{2,}', ' ', 'g')) AS x
  FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS para_no, x AS text FROM c
WHERE x <> ''""")
def _(t):
    broken = t.documents.selectExpr(
        "doc_id", "replace(replace(text, 'ti', 't-\\ni'), '. ', '.  \\n\\n') AS text")
    return numbered_rows(broken, ["doc_id"], tx.paragraphs(tx.join_hyphens(F.col("text"))), "para_no", "text")


@query("terminal_punctuation", f"""WITH {lines_cte()}, c AS (SELECT doc_id, i, trim(x) AS b,
  regexp_replace(trim(x), '[\\s:;,\\-–—«»"“”''’]+$', '') AS y FROM l)
SELECT doc_id, CAST(i - 1 AS INT) AS line_no, CASE WHEN y = '' THEN b WHEN right(y, 1) IN ('.', '!', '?', '…') THEN y
  ELSE y || '.' END AS spoken FROM c""")
def _(t):
    rows = numbered_rows(t.documents, ["doc_id"], tx.lines(F.col("text")), "line_no", "x")
    return rows.select("doc_id", "line_no", tx.closed_for_speech(F.col("x")).alias("spoken"))


@query("key_normalisation", """
SELECT c_custkey AS id, lower(trim(concat('  D’', c_name, ' '))) AS raw, replace(lower(trim(concat('  D’', c_name, ' '))),
  '’', '''') AS key FROM customer""")
def _(t):
    from lectern.operators.catalog import name_key

    name = F.concat(F.lit("  D’"), "c_name", F.lit(" "))
    return t.customer.select(F.col("c_custkey").alias("id"), F.lower(F.trim(name)).alias("raw"),
                             name_key(name).alias("key"))


@query("direction_brackets", """
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'DIDAS' ELSE 'ANNA' END AS speaker,
  CASE WHEN turn % 2 = 0 THEN concat(' ( ', text, ' ) ') ELSE concat('(', text) END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN speaker = 'DIDAS' AND starts_with(trim(text), '(') AND ends_with(trim(text), ')')
  THEN trim(substr(trim(text), 2, length(trim(text)) - 2), ' ' || chr(10)) ELSE text END AS text FROM r""")
def _(t):
    return t.conversations.selectExpr(
        "conv_id", "turn", "CASE WHEN role = 'user' THEN 'DIDAS' ELSE 'ANNA' END AS speaker",
        "CASE WHEN turn % 2 = 0 THEN concat(' ( ', text, ' ) ') ELSE concat('(', text) END AS text").select(
        "conv_id", "turn", tx.without_direction_brackets(F.col("speaker"), F.col("text")).alias("text"))


_QUOTED = "concat(' — ', replace(replace(text, '. ', ' » {«'), ', ', '\" ’ –'), '}')"


@query("segment_text_clean", f"""WITH d AS (SELECT doc_id, {_QUOTED} AS text FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '{{}}', '  '), '[«»"]', '', 'g'),
  '^\\s*[—–]\\s*', ''), '\\s+', ' ', 'g')) AS text FROM d""")
def _(t):
    return t.documents.selectExpr("doc_id", f"{_QUOTED} AS text").select(
        "doc_id", tx.clean_segment(F.col("text")).alias("text"))


@query("comparison_normal_form", f"""WITH d AS (SELECT doc_id, {_QUOTED} AS text FROM documents)
SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[«»"‘’–—]', ' ', 'g'), '\\s+', ' ', 'g'))) AS text
FROM d""")
def _(t):
    return t.documents.selectExpr("doc_id", f"{_QUOTED} AS text").select(
        "doc_id", tx.comparison_form(F.col("text")).alias("text"))


@query("chunk_preview", """
SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 140) AS preview, CAST(length(text) AS INT) AS chars
FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.preview(F.col("text")).alias("preview"), F.length("text").alias("chars"))


@query("content_fingerprint_reuse", """
WITH f AS (SELECT doc_id, md5(concat(source, text)) AS key FROM documents),
m AS (SELECT key, min(doc_id) AS first_id FROM f GROUP BY 1)
SELECT f.doc_id, f.key, m.first_id, f.doc_id > m.first_id AS reused FROM f JOIN m USING (key)""")
def _(t):
    docs = t.documents.select("doc_id", tx.fingerprint(F.encode("source", "UTF-8"), F.col("text")).alias("key"))
    return corpus.first_holder(docs, "key", "doc_id")


@query("rule_dry_run", f"""WITH {lines_cte()}, r AS (
  SELECT 0 AS rule, doc_id, x, regexp_replace(x, '(?i)([A-Za-z]+)tion', '\\1-TION', 'g') AS y,
    len(regexp_extract_all(x, '(?i)([A-Za-z]+)tion')) AS n FROM l
  UNION ALL SELECT 6, doc_id, x, regexp_replace(x, '[0-9]{{3,}}', '', 'g'), len(regexp_extract_all(x, '[0-9]{{3,}}'))
  FROM l)
SELECT rule, count(*) AS changed_lines, CAST(sum(n) AS BIGINT) AS matches, count(DISTINCT doc_id) AS documents FROM r
WHERE x <> y GROUP BY 1""")
def _(t):
    return corpus.rule_dry_run(t.documents, [RULES[0], tx.Rule("/[oops/"), *[tx.Rule("")] * 4, RULES[6]])


@query("rule_dry_run_lines", f"""WITH {lines_cte()}
SELECT doc_id, CAST(i - 1 AS INT) AS line_no, x AS before, regexp_replace(x, '[0-9]+', '#', 'g') AS after FROM l
WHERE regexp_matches(x, '[0-9]')""")
def _(t):
    return corpus.changed_lines(t.documents, tx.Rule("/[0-9]+/", "#"))


@query("display_columns", """
SELECT event_id, concat(CAST(floor(floor(value) / 60) AS BIGINT), ':', lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS
  VARCHAR), 2, '0')) AS length, CASE event_id % 5 WHEN 0 THEN 'Qwen 1.7B' WHEN 1 THEN 'Chatterbox Turbo' WHEN 2 THEN 'kokoro'
  WHEN 3 THEN 'LuxTTS' ELSE 'Qwen' END AS engine FROM events""")
def _(t):
    e = t.events.selectExpr("event_id", "value", "CASE event_id % 5 WHEN 0 THEN 'qwen' WHEN 1 THEN 'chatterbox_turbo' "
                            "WHEN 2 THEN 'kokoro' WHEN 3 THEN 'luxtts' END AS engine")
    return e.select("event_id", tx.minutes_seconds(F.col("value")).alias("length"),
                    tx.engine_label(F.col("engine"), F.lit("1.7B")).alias("engine"))


@query("display_file_size", """
WITH s AS (SELECT o_orderkey AS id, CAST(o_orderkey AS BIGINT) * o_orderkey * 37 AS bytes FROM orders),
u AS (SELECT *, CASE WHEN bytes >= 1073741824 THEN 3 WHEN bytes >= 1048576 THEN 2 WHEN bytes >= 1024 THEN 1 ELSE 0 END AS p
  FROM s)
SELECT id, bytes, CASE WHEN bytes = 0 THEN '0 Bytes' ELSE concat(regexp_replace(printf('%.2f',
  floor(bytes / pow(1024.0, p) * 100 + 0.5) / 100), '\\.?0+$', ''), ' ',
  CASE p WHEN 0 THEN 'Bytes' WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' ELSE 'GB' END) END AS shown FROM u""")
def _(t):
    s = t.orders.selectExpr("o_orderkey AS id", "o_orderkey * o_orderkey * 37 AS bytes")
    return s.withColumn("shown", tx.file_size(F.col("bytes")))


@query("timestamp_text_zone", """
SELECT event_id, CASE event_id % 3 WHEN 2 THEN ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE ELSE ts END AS instant
FROM events""")
def _(t):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.expr(
        "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+05:30' END"))
    return t.events.select("event_id", tx.utc_instant(text).alias("instant"))


@query("sample_set_fingerprint", ctes("samples") + """
SELECT profile_id, substr(md5(string_agg(CAST(id AS VARCHAR), '-' ORDER BY CAST(id AS VARCHAR))), 1, 12) AS fingerprint
FROM samples GROUP BY 1""")
def _(t):
    return corpus.set_fingerprint(t.samples, "profile_id", "id")
