"""Plays and speaker attribution.

The given texts hold prose only, so headings, names, quotes and replies are
put into them by a row-wise derivation stated once for Spark and once for SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows, plain_rows
from lectern.operators import attribution as at
from lectern.operators import play
from lectern.plans.chunks import script_cte, scripts
from lectern.plans.registry import ORACLES, query
from lectern.plans.text import lines_cte
from lectern.session import written

NAMES = ["ANNA", "LE VIEUX BORIS", "CLARA"]

_PLAY_CASE = ("CASE i % 9 WHEN 1 THEN concat('ACTE ', i) WHEN 2 THEN 'Anna' WHEN 5 THEN concat('Clara, ', x) WHEN 7 THEN "
              "concat('le vieux boris (bas) ', x) WHEN 8 THEN concat(x, ' (il rit (fort)) fin') ELSE x END")


def plays(t, *more):
    def line(x, n):
        i = n + 1
        return F.when(i % 9 == 1, F.concat(F.lit("ACTE "), i.cast("string"))).when(i % 9 == 2, "Anna").when(
            i % 9 == 5, F.concat(F.lit("Clara, "), x)).when(i % 9 == 7, F.concat(F.lit("le vieux boris (bas) "), x)).when(
            i % 9 == 8, F.concat(x, F.lit(" (il rit (fort)) fin"))).otherwise(x)

    return t.documents.select(
        "doc_id", *more, F.array_join(F.transform(tx.lines(F.col("text")), line), "\n\n").alias("text"))


_BLOCKS = f"""{lines_cte()}, b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, trim(y) AS y
  FROM (SELECT doc_id, i, {_PLAY_CASE} AS y FROM l) WHERE trim(y) <> ''),
c AS (SELECT *, CASE WHEN starts_with(y, 'ACTE') OR starts_with(y, 'SCÈNE') THEN 'heading'
  WHEN regexp_matches(y, '(?i)^(anna|le vieux boris|clara)\\s*(\\([^)]*\\)|,)') THEN 'inline'
  WHEN upper(y) IN ('ANNA', 'LE VIEUX BORIS', 'CLARA') THEN 'name' ELSE 'text' END AS kind FROM b),
n AS (SELECT *, CASE WHEN kind IN ('inline', 'name') THEN upper(regexp_extract(y, '(?i)^(anna|le vieux boris|clara)', 1))
  END AS name, count(*) FILTER (kind = 'heading') OVER (PARTITION BY doc_id ORDER BY k) AS scene FROM c)"""


@query("play_block_speakers", f"""WITH {_BLOCKS}
SELECT doc_id, CAST(k AS INT) AS block_no, kind, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id, scene ORDER BY k)
AS speaker FROM n""")
def _(t):
    return play.block_speakers(plays(t), "text", "doc_id", NAMES)


@query("play_parse", f"""WITH {_BLOCKS},
a AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id, scene ORDER BY k) AS who,
  y LIKE '%(%' AND y LIKE '%)%' AS boxed FROM n),
-- the balanced outer brackets of this derivation: none, one level or two levels deep
p AS (SELECT *, CASE WHEN kind = 'text' AND who IS NOT NULL AND boxed THEN list_filter(list_transform(string_split(
  regexp_replace(y, '(\\((?:[^()]|\\([^()]*\\))*\\))', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)),
  lambda z: z <> '') END AS parts FROM a),
-- plain blocks alternate; anything else sets the side they start from
g AS (SELECT *, kind = 'text' AND who IS NOT NULL AND NOT boxed AS plain FROM p),
h AS (SELECT *, count(*) FILTER (NOT plain) OVER (PARTITION BY doc_id ORDER BY k) AS anchor,
  CASE WHEN parts IS NOT NULL THEN NOT (starts_with(parts[-1], '(') AND ends_with(parts[-1], ')'))
    WHEN NOT plain THEN false END AS spoken FROM g),
q AS (SELECT *, coalesce(first_value(spoken) OVER (PARTITION BY doc_id, anchor ORDER BY k), false) AS from_speech,
  count(*) FILTER (plain) OVER (PARTITION BY doc_id, anchor ORDER BY k) AS nth FROM h),
r AS (SELECT doc_id, k, 0 AS j, CASE WHEN plain AND (nth % 2 = 1) <> from_speech THEN who ELSE 'DIDAS' END AS speaker,
  CASE kind WHEN 'inline' THEN concat(name, ', ', trim(regexp_replace(y, '(?i)^(anna|le vieux boris|clara)\\s*,?\\s*', '')))
    ELSE y END AS text FROM q WHERE kind <> 'name' AND parts IS NULL
  UNION ALL SELECT doc_id, k, j, CASE WHEN starts_with(parts[j], '(') AND ends_with(parts[j], ')') THEN 'DIDAS' ELSE who
    END, parts[j] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM q WHERE parts IS NOT NULL))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INT) AS line_no, speaker, text FROM r""")
def _(t):
    parsed = play.parse_play(plays(t), "text", "p", NAMES)
    return numbered_rows(parsed, ["doc_id"], "p", "line_no", "r").select("doc_id", "line_no", "r.*")


# The strict form: exact names, `NAME, direction` alone, brackets that do not nest.
_STRICT_BLOCKS = f"""{lines_cte()}, b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, trim(y) AS y
  FROM (SELECT doc_id, i, CASE WHEN i % 9 = 2 AND i < max(i) OVER (PARTITION BY doc_id) THEN 'ANNA'
    WHEN i % 9 = 5 THEN concat('CLARA, ', x) ELSE replace({_PLAY_CASE}, 'Clara,', 'CLARA,') END AS y FROM l) WHERE trim(y) <> ''),
c AS (SELECT *, CASE WHEN starts_with(y, 'ACTE') OR starts_with(y, 'SCÈNE') THEN 'heading'
  WHEN contains(y, ',') AND trim(split_part(y, ',', 1)) IN ('ANNA', 'LE VIEUX BORIS', 'CLARA') THEN 'inline'
  WHEN y IN ('ANNA', 'LE VIEUX BORIS', 'CLARA') THEN 'name' ELSE 'text' END AS kind FROM b),
n AS (SELECT *, CASE WHEN kind IN ('inline', 'name') THEN trim(split_part(y, ',', 1)) END AS name,
  count(*) FILTER (kind = 'heading') OVER (PARTITION BY doc_id ORDER BY k) AS scene FROM c)"""
_STRICT_PARSE = ORACLES["play_parse"].replace(_BLOCKS, _STRICT_BLOCKS).replace(
    "'(\\((?:[^()]|\\([^()]*\\))*\\))'", "'(\\([^)]*\\))'").replace(
    "concat(name, ', ', trim(regexp_replace(y, '(?i)^(anna|le vieux boris|clara)\\s*,?\\s*', '')))",
    "concat(upper(left(name, 1)), lower(substr(name, 2)), ', ', trim(substr(y, strpos(y, ',') + 1)))")


@query("play_parse_strict", _STRICT_PARSE)
def _(t):
    upper = plays(t).withColumn("text", F.replace(F.replace("text", F.lit("\nAnna\n"), F.lit("\nANNA\n")),
                                                   F.lit("Clara,"), F.lit("CLARA,")))
    parsed = play.parse_play(upper, "text", "p", NAMES, strict=True)
    return numbered_rows(parsed, ["doc_id"], "p", "line_no", "r").select("doc_id", "line_no", "r.*")


@query("play_style_format", f"""WITH {lines_cte()},
y AS (SELECT doc_id, i, (i - 1) % 3 AS kind, trim(x) <> '' AS had, trim(regexp_replace(CASE (i - 1) % 3 WHEN 0 THEN
  'Anna (bas) — ' || x WHEN 1 THEN 'clara – ' || x ELSE x END, '%%%|&&&|###', '', 'g')) AS z FROM l),
k AS (SELECT * FROM y WHERE NOT (had AND z = '') AND NOT regexp_matches(z, '^[0-9]+$|^[0-9]+\\.\\s+.*$')),
g AS (SELECT *, count(*) FILTER (kind < 2) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM k),
s AS (SELECT doc_id, grp, min(kind) AS kind, string_agg(z, ' ' ORDER BY i) AS z FROM g GROUP BY 1, 2),
b AS (SELECT doc_id, grp, kind, regexp_replace(CASE WHEN kind = 0 THEN '(bas) ' || trim(regexp_replace(z, '^Anna \\(bas\\) —', ''))
  ELSE trim(regexp_replace(z, '^clara –', '')) END, '%%%|&&&|###', '', 'g') AS body FROM s)
SELECT doc_id, string_agg(CASE WHEN kind = 0 THEN 'ANNA' ELSE 'CLARA' END || CASE WHEN body = '' THEN '' ELSE
  chr(10) || chr(10) || body END, chr(10) || chr(10) ORDER BY grp) || chr(10) AS out FROM b GROUP BY 1""")
def _(t):
    dashed = t.documents.select("doc_id", F.array_join(F.transform(tx.lines(F.col("text")), lambda x, n: F.when(
        n % 3 == 0, F.concat(F.lit("Anna (bas) — "), x)).when(n % 3 == 1, F.concat(F.lit("clara – "), x)).otherwise(x)),
        "\n").alias("text"))
    done = play.normalise_text(dashed, "text", "out", "modern", NAMES, [tx.Rule("%%%|&&&|###", "")])
    return done.select("doc_id", "out")


@query("corpus_normalise_plain", f"""WITH {lines_cte()}, k AS (SELECT doc_id, i, x,
  regexp_replace(x, '%%%|&&&|###', '', 'g') AS y FROM l
  WHERE NOT regexp_matches(trim(x), '^[-–—]?\\s*[0-9]+\\s*[-–—]?$')
  AND NOT regexp_matches(lower(trim(x)), '^(page|p\\.)\\s*[0-9]+$')),
c AS (SELECT doc_id, i, y, lag(y) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM k
  WHERE NOT (trim(x) <> '' AND trim(y) = ''))
SELECT d.doc_id, coalesce(string_agg(c.y, chr(10) ORDER BY c.i) FILTER (NOT (c.y = '' AND coalesce(c.b, 'x') = '')), '')
  AS text FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def _(t):
    done = play.normalise_text(t.documents, "text", "out", "none", rules=[tx.Rule("%%%|&&&|###", "")])
    return done.select("doc_id", F.col("out").alias("text"))


@query("name_line_split", f"""WITH {lines_cte()}, m AS (SELECT doc_id, i, CASE i % 3 WHEN 0 THEN 'ANNA' WHEN 1 THEN
  concat(' LE VIEUX BORIS ', x) ELSE x END AS x FROM l)
SELECT doc_id, CAST(i - 1 AS INT) AS line_no, CASE i % 3 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'LE VIEUX BORIS' END AS name,
  CASE WHEN i % 3 = 1 AND trim(x) <> 'LE VIEUX BORIS' THEN trim(substr(trim(x), 16)) END AS rest FROM m""")
def _(t):
    made = F.transform(tx.lines(F.col("text")), lambda x, n: F.when((n + 1) % 3 == 0, "ANNA").when(
        (n + 1) % 3 == 1, F.concat(F.lit(" LE VIEUX BORIS "), x)).otherwise(x))
    rows = numbered_rows(t.documents, ["doc_id"], made, "line_no", "x")
    return rows.select("doc_id", "line_no", play.split_name(F.col("x"), NAMES).alias("s")).select(
        "doc_id", "line_no", "s.*")


@query("adjacent_duplicate_lines", f"""WITH {lines_cte()}, m AS (SELECT doc_id, i * 2 AS i, trim(x) AS x FROM l
  WHERE trim(x) <> '' UNION ALL SELECT doc_id, i * 2 + 1, lower(trim(x)) FROM l WHERE trim(x) <> '' AND i % 2 = 0),
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM m)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, x AS line FROM p
WHERE b IS NULL OR lower(b) <> lower(x)""")
def _(t):
    doubled = F.flatten(F.transform(tx.lines(F.col("text")), lambda x, n: F.when(
        (n + 1) % 2 == 0, F.array(x, F.lower(x))).otherwise(F.array(x))))
    return numbered_rows(t.documents, ["doc_id"], play.drop_repeats(doubled), "line_no", "line")


@query("direction_heuristics", f"""WITH {lines_cte()}, m AS (SELECT doc_id, i, 1 AS part, trim(CASE i % 5 WHEN 0 THEN
  concat('(', left(x, 30), ')') WHEN 1 THEN concat('ANNA, ', x) WHEN 2 THEN concat('SCÈNE ', x) WHEN 3 THEN lower(x) ELSE x END) AS x
  FROM l UNION ALL SELECT doc_id, i, 2, trim(concat('(', substr(x, 31), ')')) FROM l WHERE i % 5 = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS INT) AS line_no, NOT (x = 'SCÈNE' OR starts_with(x, 'SCÈNE ')) AND (
  (starts_with(x, '(') AND ends_with(x, ')') AND length(x) < 40) OR starts_with(x, 'ANNA,') OR starts_with(x, 'CLARA,')
  OR regexp_matches(lower(x), 'un temps|regarde|geste|silence|entre|sort|sursaute|regardant|à voix basse|ironiquement|doucement|embarrassée|se met à rire')
  OR (left(x, 1) = lower(left(x, 1)) AND left(x, 1) <> upper(left(x, 1)))) AS direction FROM m""")
def _(t):
    bracketed = lambda x: F.concat(F.lit("("), x, F.lit(")"))
    made = F.flatten(F.transform(tx.lines(F.col("text")), lambda x, n: F.when((n + 1) % 5 == 0, F.array(
        bracketed(F.substring(x, 1, 30)), bracketed(F.substring(x, 31, 2 ** 31 - 1)))).otherwise(F.array(
            F.when((n + 1) % 5 == 1, F.concat(F.lit("ANNA, "), x)).when((n + 1) % 5 == 2, F.concat(F.lit("SCÈNE "), x)).when(
                (n + 1) % 5 == 3, F.lower(x)).otherwise(x)))))
    rows = numbered_rows(t.documents, ["doc_id"], made, "line_no", "x")
    return rows.select("doc_id", "line_no", play.is_direction(F.col("x"), ["ANNA", "CLARA"]).alias("direction"))


@query("scene_title_merge", f"""WITH {lines_cte()}, m AS (SELECT doc_id, i, CASE WHEN (i - 1) % 4 = 0 THEN 'SCÈNE' ELSE x END
  AS x FROM l), f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) = 'SCÈNE' AS taken,
  lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM m WHERE trim(x) <> ''),
o AS (SELECT doc_id, i, CASE WHEN x = 'SCÈNE' THEN CASE WHEN nxt IS NULL THEN x ELSE
  'SCÈNE ' || regexp_extract(trim(nxt), '^[^\\s]+') END WHEN taken THEN
  trim(regexp_replace(trim(x), '^[^\\s]+', '')) ELSE x END AS line, taken FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, line FROM o
WHERE line <> ''""")
def _(t):
    made = F.transform(tx.lines(F.col("text")), lambda x, n: F.when(n % 4 == 0, "SCÈNE").otherwise(x))
    return numbered_rows(t.documents.select("doc_id", made.alias("a")), ["doc_id"],
                         play.merge_scene_titles(F.col("a")), "line_no", "line")


# Each line is one step: the lines kept so far and the last direction, carried by recursion.
_NORM = "replace(lower(trim(regexp_replace(trim({x}), '^\\[DIDASCALIE\\]', ''))), '  ', ' ')"


@query("direction_dedupe", f"""WITH RECURSIVE {lines_cte()},
m AS (SELECT doc_id, i * 4 AS i, 'plain' AS kind, trim(x) AS x FROM l WHERE i % 3 <> 1
  UNION ALL SELECT doc_id, i * 4, 'tagged', trim('[DIDASCALIE] ' || x) FROM l WHERE i % 3 = 1
  UNION ALL SELECT doc_id, i * 4 + 1, 'tagged', trim('[DIDASCALIE] ' || substr(x, 1, 12)) FROM l WHERE i % 3 = 1
  UNION ALL SELECT doc_id, i * 4 + 1, 'name', 'CLARA' FROM l WHERE i % 3 = 2
  UNION ALL SELECT doc_id, i * 4 + 2, 'bare', '[DIDASCALIE] ' || trim(x) FROM l WHERE i % 3 = 2
  UNION ALL SELECT doc_id, i * 4 + 3, 'tagged', trim('[DIDASCALIE] CLARA, ' || x) FROM l WHERE i % 3 = 2),
t AS (SELECT doc_id, kind, x, {_NORM.format(x='x')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
w AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS last FROM t
  UNION ALL SELECT doc_id, k, CASE WHEN kind IN ('plain', 'name', 'bare') THEN list_append(kept, x) WHEN last IS NOT DISTINCT
    FROM n THEN kept WHEN p IS NULL THEN list_append(kept, x) WHEN contains({_NORM.format(x='p')}, n) THEN kept
    ELSE list_append(kept[:-2], x) END, CASE WHEN kind = 'plain' THEN NULL WHEN kind = 'bare' OR (kind = 'tagged' AND last IS
    DISTINCT FROM n AND p IS NULL) THEN n ELSE last END
  FROM (SELECT t.*, w.kept, w.last, list_filter(w.kept[-3:], lambda q: starts_with(q, '[DIDASCALIE]') AND
    (contains({_NORM.format(x='q')}, t.n) OR contains(t.n, {_NORM.format(x='q')})))[1] AS p
    FROM w JOIN t ON t.doc_id = w.doc_id AND t.k = w.k + 1))
SELECT doc_id, CAST(j - 1 AS INT) AS line_no, kept[j] AS line FROM (SELECT doc_id, kept, unnest(range(1, len(kept) + 1)) AS j
  FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1))""")
def _(t):
    tagged = lambda x: F.concat(F.lit("[DIDASCALIE] "), x)
    made = F.flatten(F.transform(tx.lines(F.col("text")), lambda x, n: F.when(
        n % 3 == 0, F.array(tagged(x), tagged(F.substring(x, 1, 12)))).when(
        n % 3 == 1, F.array(x, tagged(F.concat(F.lit("CLARA, "), x)))).otherwise(F.array(x))))
    return numbered_rows(t.documents.select("doc_id", made.alias("a")), ["doc_id"],
                         play.dedupe_directions(F.col("a"), NAMES), "line_no", "line")


@query("broken_line_join", f"""WITH {lines_cte()}, m AS (SELECT doc_id, i, CASE WHEN i % 7 = 0 THEN
  concat('[DIDASCALIE] ', trim(x)) WHEN i % 3 = 0 THEN trim(x, ' .') ELSE trim(x) END AS x FROM l WHERE trim(x) <> ''),
f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM m),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR regexp_matches(b, '[.!?…]$|\\.\\)$') OR starts_with(b, '[DIDASCALIE]')
  OR starts_with(x, '[DIDASCALIE]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM f)
SELECT doc_id, CAST(grp - 1 AS INT) AS line_no, trim(string_agg(x, ' ' ORDER BY i)) AS line FROM g GROUP BY 1, 2""")
def _(t):
    made = F.array_compact(F.transform(tx.lines(F.col("text")), lambda x, n: F.when(tx.strip(x) != "", F.when(
        (n + 1) % 7 == 0, F.concat(F.lit("[DIDASCALIE] "), tx.strip(x))).when(
        (n + 1) % 3 == 0, F.btrim(x, F.lit(" ."))).otherwise(tx.strip(x)))))
    joined = play.join_broken_lines(t.documents.select("doc_id", made.alias("a")), "a", "j")
    return numbered_rows(joined, ["doc_id"], "j", "line_no", "line")


# A blank span takes the style of the spans with text before and after it, italic only if both are.
@query("italic_runs", f"""WITH {lines_cte()}, s AS (SELECT doc_id, i * 2 AS k, x, i % 3 = 1 AS it FROM l
  UNION ALL SELECT doc_id, i * 2 + 1, chr(10), NULL FROM l),
t AS (SELECT *, CASE WHEN trim(x, ' ' || chr(10)) <> '' THEN it END AS own FROM s),
u AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), false) AND coalesce(first_value(
  own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS st FROM t),
g AS (SELECT *, sum(CASE WHEN b IS DISTINCT FROM st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM
  (SELECT *, lag(st) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM u)),
r AS (SELECT doc_id, grp, any_value(st) AS st, string_agg(x, '' ORDER BY k) AS x FROM g GROUP BY 1, 2),
w AS (SELECT doc_id, string_agg(CASE WHEN st AND trim(x, ' ' || chr(10)) <> '' THEN regexp_replace(x, '(?s)^(\\s*)(.*?)(\\s*)$',
  '\\1(\\2)\\3') ELSE x END, '' ORDER BY grp) AS x FROM r GROUP BY 1)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '\\(\\s*\\(\\s*(.*?)\\s*\\)\\s*\\)', '(\\1)', 'g'),
  '[ \\t]*\\([ \\t]*', ' (', 'g'), '[ \\t]*\\)[ \\t]*', ') ', 'g') AS text FROM documents LEFT JOIN w USING (doc_id)""")
def _(t):
    spans = F.flatten(F.transform(tx.lines(F.col("text")), lambda x, n: F.array(
        F.struct(x.alias("text"), (n % 3 == 0).alias("is_italic")),
        F.struct(F.lit("\n").alias("text"), F.lit(None).cast("boolean").alias("is_italic")))))
    return t.documents.select("doc_id", play.italic_runs(spans).alias("text"))


# ---------------------------------------------------------------- attribution on conversation turns

_TALK = "replace(replace(text, ', ', ' — '), '. ', concat('.', chr(10), ' — '))"
_TALK_SPARK = "replace(replace(text, ', ', ' — '), '. ', '.\\n — ')"


def _dash_sql(source: str) -> str:
    """Texts of `source(doc_id, text)` with their dashes marked."""
    return f"""SELECT doc_id, string_agg(x || CASE WHEN k = n THEN '' WHEN start THEN '}}—' WHEN inl % 2 = 1 THEN '—{{' ELSE '}}—'
  END, '' ORDER BY k) AS text FROM (SELECT *, count(*) FILTER (NOT start AND k < n) OVER (PARTITION BY doc_id ORDER BY k)
  AS inl FROM (SELECT *, ends_with(rtrim(x, ' ' || chr(9)), chr(10)) OR (k = 1 AND rtrim(x, ' ' || chr(9)) = '') AS start
  FROM (SELECT doc_id, k, a[k] AS x, len(a) AS n FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS k FROM
  (SELECT doc_id, string_split(text, '—') AS a FROM {source}))))) GROUP BY 1"""


@query("dash_markup", f"WITH t AS (SELECT doc_id, {_TALK} AS text FROM documents) {_dash_sql('t')}")
def _(t):
    talk = t.documents.selectExpr("doc_id", f"{_TALK_SPARK} AS text")
    return talk.select("doc_id", at.mark_dashes(F.col("text")).alias("text"))


_QUOTED = ("replace(replace(replace(text, ', ', ' « '), '. ', ' ». '), ' la ', ' dit « ')")


# Quotes in order, each with the text before it; what follows the last closed quote stays as it is.
_STEM_SQL = "^(?:" + "|".join(x.replace("'", "''") for x in at.SPEECH_STEMS) + ")"
_QUOTE_SQL = f"""d AS (SELECT doc_id, {_QUOTED} AS text FROM documents),
e AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)([^«]*)«(.*?)»', 1) AS bs,
  regexp_extract_all(text, '(?s)([^«]*)«(.*?)»', 2) AS qs FROM d),
p AS (SELECT doc_id, k, bs[k] AS b, qs[k] AS q FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS k FROM e)),
c AS (SELECT *, rtrim(coalesce('«' || lag(q) OVER (PARTITION BY doc_id ORDER BY k) || '»', '') || b, ' ' || chr(10)) AS ctx
  FROM p),
w AS (SELECT *, replace(lower(trim(regexp_extract(ctx, '(\\S+)$', 1), '.,;!?»«"()')), '’', '''') AS base,
  left(trim(q, ' ' || chr(10)), 1) AS f FROM c),
s AS (SELECT *, ctx = '' OR regexp_matches(ctx, '[:—–}}.!?…]$') OR (f = upper(f) AND f <> lower(f))
  OR regexp_matches(base, '{_STEM_SQL}')
  OR regexp_matches(regexp_extract(split_part(base, '-', 1), '([^'']*)$', 1), '{_STEM_SQL}') AS speech FROM w),
m AS (SELECT doc_id, string_agg(b || CASE WHEN speech THEN '}}«' || q || '»{{' ELSE '«' || q || '»' END, '' ORDER BY k) AS t,
  sum(length(b) + length(q) + 2) AS used FROM s GROUP BY 1),
quoted AS (SELECT e.doc_id, e.text AS raw, coalesce(m.t, '') || substr(e.text, CAST(coalesce(m.used, 0) AS BIGINT) + 1)
  AS text FROM e LEFT JOIN m USING (doc_id))"""


@query("quote_markup", f"WITH {_QUOTE_SQL} SELECT doc_id, text FROM quoted")
def _(t):
    marked = at.mark_quotes(t.documents.selectExpr("doc_id", f"{_QUOTED} AS text"), "text", "out")
    return marked.select("doc_id", F.col("out").alias("text"))


# Two of seven documents are given in marked form, which must come back unchanged.
_TURNS = (f"CASE WHEN doc_id % 7 < 2 THEN concat('a }}« b »{{ — ', {_QUOTED}) ELSE replace({_QUOTED}, ' de ', ' — ') END")


@query("turn_premarkup", f"""WITH {_QUOTE_SQL.replace(_QUOTED, _TURNS)}, dashed AS ({_dash_sql('quoted')})
SELECT q.doc_id, CASE WHEN contains(raw, '}}«') OR contains(raw, '»{{') THEN raw ELSE d.text END AS text
FROM quoted q JOIN dashed d USING (doc_id)""")
def _(t):
    marked = at.premark_turns(t.documents.selectExpr("doc_id", f"{_TURNS} AS text"), "text", "out")

    return marked.select("doc_id", F.col("out").alias("text"))


# The aside grammar in DuckDB's dialect: letters and digits of all languages are words, and a verb ends at a blank or hyphen.
_ASIDE_SQL = (at.ASIDE.removeprefix("(?U)").replace("[\\wÀ-ÿ", "[\\p{L}\\p{N}_").replace("\\w", "[\\p{L}\\p{N}_]")
              .replace("\\b", "").replace("'", "''"))


@query("aside_premarkup", f"""WITH d AS (SELECT doc_id, replace(replace(text, ', ', ' » dit le Vieux, « '), '. ',
  concat('.', chr(10), '— ')) AS text FROM documents), {lines_cte('d')},
c AS (SELECT doc_id, i, 0 AS j, '' AS x FROM l WHERE trim(x) = '' UNION ALL SELECT * FROM (SELECT doc_id, i, j, trim(a[j]) AS x
  FROM (SELECT *, unnest(range(1, len(a) + 1)) AS j FROM (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(trim(x),
  '([»”])', '\\1' || chr(10), 'g'), '([«“—–])', chr(10) || '\\1', 'g'), chr(10)) AS a FROM l WHERE trim(x) <> ''))) WHERE x <> ''),
f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i, j) AS b FROM c),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR b = '' OR x = '' OR regexp_matches(x, '^[—–\\-«“"]')
  OR regexp_matches(b, '^[—–\\-«“"]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i, j) AS grp FROM f),
p AS (SELECT doc_id, grp, string_agg(x, ' ' ORDER BY i, j) AS x FROM g GROUP BY 1, 2 HAVING string_agg(x, ' ' ORDER BY i, j) <> ''),
m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '({_ASIDE_SQL})', chr(1) || '\\1' || chr(2), 'g'), chr(1) || '\\s*', ' (', 'g'),
  '\\s*' || chr(2), ') ', 'g') AS y FROM p)
SELECT doc_id, coalesce(string_agg(CASE WHEN regexp_matches(x, '[—–\\-«»"“]') THEN regexp_replace(regexp_replace(trim(regexp_replace(y,
  '\\s+', ' ', 'g')), ',\\s*\\(', ' (', 'g'), '\\)\\s*,', ')', 'g') ELSE concat('(', x, ')') END, chr(10) || chr(10) ORDER BY grp), '')
  AS text FROM documents LEFT JOIN m USING (doc_id) GROUP BY 1""")
def _(t):
    story = t.documents.selectExpr("doc_id", "replace(replace(text, ', ', ' » dit le Vieux, « '), '. ', '.\\n— ') AS text")
    return at.premark(story, "text", "out").select("doc_id", F.col("out").alias("text"))


@query("dialogue_paragraphs", f"""WITH d AS (SELECT doc_id, replace(replace(text, '. ', concat('.', chr(10), '— ')), ', ',
  concat(',', chr(10))) AS text FROM documents),
l AS (SELECT doc_id, i, trim(a[i]) AS x FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM
  (SELECT doc_id, string_split(text, chr(10)) AS a FROM d))),
f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR b = '' OR x = '' OR regexp_matches(x, '^[—–\\-«“"]')
  OR regexp_matches(b, '^[—–\\-«“"]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM f),
p AS (SELECT doc_id, grp, string_agg(x, ' ' ORDER BY i) AS x FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INT) AS para_no, x AS text FROM p
WHERE x <> ''""")
def _(t):
    story = t.documents.selectExpr("doc_id", "replace(replace(text, '. ', '.\\n— '), ', ', ',\\n') AS text")
    built = at.dialogue_paragraphs(story, "text", "p")
    return numbered_rows(built, ["doc_id"], "p", "para_no", "text")


_MARKED = "replace(replace(concat('Il vint. ', text), ', ', ' } '), '. ', '. { ')"


@query("marker_segmentation", f"""
WITH p AS (SELECT doc_id, k, a[k] AS x FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS k FROM (SELECT doc_id,
  string_split(regexp_replace({_MARKED}, '([{{}}])', chr(1) || '\\1', 'g'), chr(1)) AS a FROM documents))),
s AS (SELECT doc_id, k, CASE WHEN starts_with(x, '}}') THEN 'S' ELSE 'N' END AS type,
  trim(regexp_replace(x, '^[{{}}]', ''), ' ' || chr(10)) AS text FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS seg_no, type, text FROM s
WHERE text <> ''""")
def _(t):
    segs = at.marked_segments(F.expr(_MARKED))
    rows = numbered_rows(t.documents, ["doc_id"], segs, "seg_no", "s")
    return rows.select("doc_id", "seg_no", "s.*")


_HEADS = """h AS (SELECT *, x = upper(x) AND x <> lower(x) AND length(x) < 50 AND NOT regexp_matches(x, '[.!?«»"–—{}]')
  AS head FROM (SELECT doc_id, i, trim(x) AS x FROM l) WHERE x <> '')"""


@query("reply_speaker_blocks", f"""WITH {script_cte()}, {_HEADS},
g AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM h),
b AS (SELECT doc_id, grp, max(x) FILTER (head) AS speaker, string_agg(x, ' ' ORDER BY i) FILTER (NOT head) AS text
  FROM g WHERE grp > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INT) AS block_no, speaker, text FROM b
WHERE text <> ''""")
def _(t):
    read = at.speaker_blocks(scripts(t), "text", "b")
    return numbered_rows(read, ["doc_id"], "b", "block_no", "b").select("doc_id", "block_no", "b.*")


@query("speakers_by_project", f"""WITH {script_cte()}, {_HEADS}
SELECT DISTINCT d.source AS project, h.x AS speaker FROM h JOIN documents d USING (doc_id)
WHERE head AND x NOT IN ('NARRATEUR', 'PERSONNAGE')""")
def _(t):
    replies = scripts(t).join(t.documents.select("doc_id", F.col("source").alias("project")), "doc_id")
    return at.project_speakers(replies.withColumnRenamed("text", "reply"))


def _chunk_replies(t):
    """Turns as marked chunks with a made-up reply: halves of the text under two names."""
    c = t.turns.selectExpr(
        "conv_id", "turn", "text", "replace(replace(text, ', ', ' }« '), '. ', '. »{ ') AS marked",
        "concat('ANNA\n', substr(text, 1, CAST(length(text) / 2 AS INT)), '\n\nNARRATEUR\nIl dit.\n\nBORIS\n', "
        "substr(text, CAST(length(text) / 2 AS INT) + 1)) AS reply")
    return c.withColumn("segments", at.marked_segments(F.col("marked")))


@query("fuzzy_speaker_assignment")
def _(t):
    done = at.assign_speakers(_chunk_replies(t), "segments", "reply", "pairs")
    return numbered_rows(done, ["conv_id", "turn"], "pairs", "seg_no", "p").select("conv_id", "turn", "seg_no", "p.*")


@query("rendered_script")
def _(t):
    done = at.assign_speakers(_chunk_replies(t), "segments", "reply", "pairs")
    return done.select("conv_id", "turn", at.rendered(at.tidy_pairs(F.col("pairs"))).alias("script"))


@query("tag_transfer")
def _(t):
    done = at.transfer_tags(_chunk_replies(t), "text", "reply", "pairs")
    return numbered_rows(done, ["conv_id", "turn"], "pairs", "seg_no", "p").select("conv_id", "turn", "seg_no", "p.*")


@query("attribution_post_process")
def _(t):
    story = _chunk_replies(t).withColumn("text", F.replace("text", F.lit(", "), F.lit(" ! dit le Vieux. ")))
    done = at.post_process(at.transfer_tags(story, "text", "reply", "pairs"), "pairs", "final")
    return numbered_rows(done, ["conv_id", "turn"], "final", "seg_no", "p").select("conv_id", "turn", "seg_no", "p.*")


@query("lost_words", """
WITH w AS (SELECT conv_id * 100 + turn AS id, unnest(list_filter(string_split_regex(lower(trim(regexp_replace(text,
  '[«»"‘’–—]', ' ', 'g'))), '\\s+'), lambda z: z <> '')) AS word, 1 AS d FROM conversations
UNION ALL SELECT conv_id * 100 + turn, unnest(list_filter(string_split_regex(lower(trim(replace(text, ' la ', ' '))), '\\s+'),
  lambda z: z <> '')), -1 FROM conversations)
SELECT id, word, CAST(sum(d) AS BIGINT) AS lost FROM w GROUP BY 1, 2 HAVING sum(d) > 0""")
def _(t):
    docs = t.turns.selectExpr("conv_id * 100 + turn AS id", "text", "replace(text, ' la ', ' ') AS after")
    return at.lost_words(docs, "id", "text", "after")


@query("integrity_ratio")
def _(t):
    docs = t.turns.selectExpr("conv_id", "turn", "text", "replace(text, ' la ', ' ') AS after")
    checked = at.integrity(docs, "text", "after", "c")
    return checked.select("conv_id", "turn", F.round("c.ratio", 6).alias("ratio"), F.size("c.lost").alias("passages"),
                          (F.col("c.ratio") >= at.INTACT_RATIO).alias("intact"))


@query("structure_lint", """
WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'NARRATEUR' ELSE upper(role) END AS speaker,
  CASE turn % 3 WHEN 0 THEN concat(' — ', text) WHEN 1 THEN text ELSE '«' END AS text FROM conversations)
SELECT conv_id, turn FROM s WHERE speaker = 'NARRATEUR' AND regexp_matches(trim(text), '^[—–\\-«“"]')
AND length(trim(text)) > 2""")
def _(t):
    return t.turns.selectExpr(
        "conv_id", "turn", "CASE WHEN role = 'user' THEN 'NARRATEUR' ELSE upper(role) END AS speaker",
        "CASE turn % 3 WHEN 0 THEN concat(' — ', text) WHEN 1 THEN text ELSE '«' END AS text").filter(
        at.narrator_speaks()).select("conv_id", "turn")


@query("best_attempt", """
WITH a AS (SELECT user_id AS chunk, CAST(event_id AS INT) AS attempt, floor(value / 25) / 20 AS ratio,
  event_id % 40 AS missing, event_id % 3 AS errors FROM events),
e AS (SELECT chunk, min(attempt) FILTER (missing = 0 AND errors = 0) AS fin FROM a GROUP BY 1),
t AS (SELECT a.* FROM a JOIN e USING (chunk) WHERE fin IS NULL OR attempt <= fin)
SELECT chunk, arg_max(attempt, (ratio, errors = 0, CASE WHEN errors = 0 THEN attempt ELSE -attempt END)) AS attempt,
  max(ratio) AS ratio, count(*) AS tries FROM t GROUP BY 1""")
def _(t):
    a = t.events.selectExpr("user_id AS chunk", "CAST(event_id AS INT) AS attempt", "floor(value / 25) / 20 AS ratio",
                            "event_id % 40 AS missing", "event_id % 3 AS errors")
    return at.best_attempts(a, "chunk")


_AI = """c AS (SELECT source AS project, doc_id AS idx FROM documents), r AS (SELECT source AS project, doc_id AS idx,
  CASE WHEN doc_id % 10 = 3 THEN concat('  ', chr(10)) ELSE text END AS text FROM documents WHERE doc_id % 4 <> 1)"""


def _ai(t):
    d = t.documents.selectExpr("source AS project", "doc_id AS idx", "text")
    blank = F.when(F.col("idx") % 10 == 3, F.lit("  \n")).otherwise(F.col("text"))
    return d, d.filter("idx % 4 <> 1").withColumn("text", blank)


@query("assembled_chunks", f"WITH {_AI} SELECT project, idx, trim(text, ' ' || chr(10)) AS text FROM r WHERE "
       "trim(text, ' ' || chr(10)) <> ''")
def _(t):
    return at.assembled(*_ai(t))


@query("assembly_report", f"""WITH {_AI} SELECT c.project, count(*) FILTER (trim(r.text, ' ' || chr(10)) <> '') AS included,
  count(*) AS total, count(*) FILTER (r.idx IS NULL) AS missing FROM c LEFT JOIN r USING (project, idx) GROUP BY 1""")
def _(t):
    return at.assembly_report(*_ai(t))


@query("missing_chunk_indexes", f"WITH {_AI} SELECT project, idx FROM c EXCEPT SELECT project, idx FROM r")
def _(t):
    return at.missing_chunks(*_ai(t))


@query("append_new_speakers", """
WITH d AS (SELECT l_suppkey AS project, row_number() OVER (PARTITION BY l_suppkey ORDER BY r) AS ord, r AS role FROM
  (SELECT DISTINCT l_suppkey, concat('R', l_partkey % 40) AS r FROM lineitem WHERE l_linenumber = 1)),
s AS (SELECT l_suppkey AS project, concat('R', l_partkey % 90) AS role, min(l_orderkey) AS pos FROM lineitem GROUP BY 1, 2),
n AS (SELECT project, role, row_number() OVER (PARTITION BY project ORDER BY pos, role) AS k FROM s
  WHERE (project, role) NOT IN (SELECT (project, role) FROM d))
SELECT project, ord, role FROM d UNION ALL SELECT n.project, coalesce((SELECT max(ord) FROM d WHERE d.project = n.project),
  0) + k, role FROM n""")
def _(t):
    from lectern.operators.ordered import row_numbers

    li = t.lineitem
    first = li.filter("l_linenumber = 1").selectExpr(
        "l_suppkey AS project", "concat('R', l_partkey % 40) AS role").distinct()
    declared = written(row_numbers(first, ["project"], ["role"], F.ascii("role").cast("bigint"), "ord"), "declared")
    seen = li.selectExpr("l_suppkey AS project", "concat('R', l_partkey % 90) AS role", "l_orderkey AS pos")
    return at.append_speakers(declared, seen)


@query("mark_as_narration", """
SELECT conv_id, turn, concat('NARRATEUR', chr(10), chr(10), trim(text, ' ' || chr(10)), chr(10)) AS text FROM conversations""")
def _(t):
    return t.turns.select("conv_id", "turn", at.as_narration(F.col("text")).alias("text"))
