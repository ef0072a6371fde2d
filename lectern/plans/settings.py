"""Rules, styles and casts that differ by project.

Each source of the given texts is a project.  The last letter of its name, by its code modulo three, decides its
settings, so rules and settings are tables that Spark derives from the texts' sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows
from lectern.operators import play, settings
from lectern.plans import dialogue
from lectern.plans.registry import ORACLES, query
from lectern.plans.text import lines_cte

_PROJECT = "coalesce(source, 'none')"
_KIND = f"ascii(right({_PROJECT}, 1)) % 3"


def _projects(t):
    return t.documents.select(F.expr(_PROJECT).alias("project"), F.expr(_KIND).alias("kind")).distinct()


def _of_kind(sql: str, *kinds: int) -> str:
    """A query over `documents` for the projects of these kinds only."""
    few = ", ".join(map(str, kinds))
    return sql.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {_KIND} IN ({few}))")


# One rule by kind, one by name, one that no JVM can run, one switched off; they are applied by position.
_RULES = r"""SELECT project, r.* FROM {projects} LATERAL VIEW explode(array(
  named_struct('position', 2, 'search', substr(project, 1, 2), 'replace', upper(project), 'active', true),
  named_struct('position', 1, 'search', CASE kind WHEN 0 THEN '/([A-Za-z]+)tion/i' WHEN 1 THEN '/[0-9]{{3,}}/' ELSE 'a|(' END,
    'replace', CASE kind WHEN 0 THEN concat(substr(project, 1, 2), '$1') WHEN 1 THEN '' ELSE '[' END, 'active', true),
  named_struct('position', 3, 'search', '/(a)?(?(1)b|c)/', 'replace', 'never', 'active', true),
  named_struct('position', 4, 'search', 'e', 'replace', 'E', 'active', false))) AS r"""


@query("project_line_rules", f"""WITH {lines_cte()}, r AS (SELECT doc_id, i, x, replace(CASE {_KIND}
  WHEN 0 THEN regexp_replace(x, '(?i)([A-Za-z]+)tion', substr({_PROJECT}, 1, 2) || '\\1', 'g')
  WHEN 1 THEN regexp_replace(x, '[0-9]{{3,}}', '', 'g') ELSE replace(x, 'a|(', '[') END,
  substr({_PROJECT}, 1, 2), upper({_PROJECT})) AS y FROM l JOIN documents USING (doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, y AS line FROM r
WHERE NOT (trim(x) <> '' AND trim(y) = '')""")
def _(t):
    rules = t.spark.sql(_RULES, projects=_projects(t))
    docs = t.documents.select("doc_id", "text", F.expr(_PROJECT).alias("project"))
    ruled = settings.with_rules(docs, rules)
    done = tx.apply_rules_to_lines(tx.lines(F.col("text")), F.col("__rules"))
    return numbered_rows(ruled, ["doc_id"], done, "line_no", "line")


def _cast(t, *by_kind):
    """Settings with the style and names of each kind."""
    style = F.element_at(F.array(*[F.lit(s) for s, _, _ in by_kind]), F.col("kind") + 1)
    names = F.element_at(F.array(*[F.array(*map(F.lit, n)) for _, n, _ in by_kind]), F.col("kind") + 1)
    pages = F.element_at(F.array(*[F.lit(p) for _, _, p in by_kind]), F.col("kind") + 1)
    return _projects(t).select(
        "project", style.alias("style"), names.alias("actors"), pages.alias("remove_page_numbers"))


_ALL, _ALL_LISTED = "anna|le vieux boris|clara", "'ANNA', 'LE VIEUX BORIS', 'CLARA'"


def _with_names(sql: str, names) -> str:
    return sql.replace(_ALL, "|".join(names).lower()).replace(_ALL_LISTED, ", ".join(f"'{n}'" for n in names))


_TWO = ["ANNA", "CLARA"]
_PLAY_SQL = ORACLES["play_parse"]


@query("project_play_parse", " UNION ALL ".join(f"(FROM ({q}))" for q in (
    _of_kind(_PLAY_SQL, 0), _of_kind(_with_names(_PLAY_SQL, _TWO), 1),
    _of_kind(_with_names(_PLAY_SQL, play.DEFAULT_ACTORS), 2))))
def _(t):
    given = _cast(t, ("modern", dialogue.NAMES, True), ("modern", ["Anna ", "clara"], True), ("modern", [" "], True))
    docs = dialogue.plays(t, F.expr(_PROJECT).alias("project"))
    parsed = settings.parse_projects(docs, given, "text", "p")
    return numbered_rows(parsed, ["doc_id"], "p", "line_no", "r").select("doc_id", "line_no", "r.*")


_STYLE_SQL = ORACLES["play_style_format"]
_NONE_SQL = f"""WITH {lines_cte()}, m AS (SELECT doc_id, i, CASE (i - 1) % 3 WHEN 0 THEN 'Anna (bas) — ' || x
  WHEN 1 THEN 'clara – ' || x ELSE x END AS x FROM l), r AS (SELECT *, regexp_replace(x, '%%%|&&&|###', '', 'g') AS y FROM m),
c AS (SELECT doc_id, i, y, lag(y) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r WHERE NOT (trim(x) <> '' AND trim(y) = ''))
SELECT doc_id, string_agg(y, chr(10) ORDER BY i) FILTER (NOT (y = '' AND coalesce(b, 'x') = '')) AS out FROM c GROUP BY 1"""


@query("project_style_format", f"(FROM ({_of_kind(_STYLE_SQL, 0, 2)})) UNION ALL (FROM ({_of_kind(_NONE_SQL, 1)}))")
def _(t):
    """The style of the last kind is one that no JVM can run, so its projects fall back to `modern`."""
    given = _cast(t, ("modern", dialogue.NAMES, True), ("none", [" "], False), ("^__ACTORS__(?(1)x|y)$", dialogue.NAMES, True))
    rules = _projects(t).selectExpr("project", "1 AS position", "'%%%|&&&|###' AS search", "'' AS replace", "true AS active")
    dashed = t.documents.select("doc_id", F.expr(_PROJECT).alias("project"), F.array_join(F.transform(
        tx.lines(F.col("text")), lambda x, n: F.when(n % 3 == 0, F.concat(F.lit("Anna (bas) — "), x)).when(
            n % 3 == 1, F.concat(F.lit("clara – "), x)).otherwise(x)), "\n").alias("text"))
    return settings.normalise_projects(dashed, rules, given, "text", "out").select("doc_id", "out")
