"""Sentences, chunks and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.rows import numbered_rows
from lectern.operators import chunking as ch
from lectern.operators import corpus
from lectern.plans.registry import query
from lectern.plans.text import RULES, _R, lines_cte


def _sentence_cte(source: str, text: str = "text", keys: str = "doc_id") -> str:
    """`s(keys, i, x)`: sentences numbered from 1, abbreviations shielded one after the other."""
    shield = text
    for a in ch.PROTECTED:
        shield = f"replace({shield}, '{a}', '{a[:-1]}' || chr(1))"
    cut = (f"regexp_replace({shield}, '([.!?…]+[\"»”''\\)\\]]?)\\s+([«\"“\\(\\[A-ZÀ-ÖØ-Þ0-9—–-])', "
           "'\\1' || chr(10) || '\\2', 'g')")
    return (f"sx AS (SELECT {keys}, list_filter(list_transform(string_split(replace({cut}, chr(1), '.'), chr(10)), "
            f"lambda z: trim(z)), lambda z: z <> '') AS a FROM {source}),\n"
            f"s AS (SELECT {keys}, i, a[i] AS x FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM sx))")


def _pack_cte(limit: int, gap: int = 1, key: str = "doc_id") -> str:
    """`w(key, i, len, g)`: the group of every part, walked one part at a time."""
    return (f"w AS (SELECT {key}, i, length(x) AS len, 0 AS g FROM s WHERE i = 1 UNION ALL "
            f"SELECT s.{key}, s.i, CASE WHEN w.len + {gap} + length(s.x) <= {limit} THEN w.len + {gap} + length(s.x) "
            f"ELSE length(s.x) END, w.g + CASE WHEN w.len + {gap} + length(s.x) <= {limit} THEN 0 ELSE 1 END "
            f"FROM w JOIN s ON s.{key} = w.{key} AND s.i = w.i + 1)")


@query("sentence_split", f"""WITH {_sentence_cte('documents')}
SELECT doc_id, CAST(i - 1 AS INT) AS n, x AS sentence FROM s""")
def _(t):
    return numbered_rows(t.documents, ["doc_id"], ch.sentences(F.col("text")), "n", "sentence")


def strict_cte(source: str, key: str = "doc_id") -> str:
    """`s(key, i, x)`: strict sentences.  The given texts hold no ellipsis sign, so no neighbours are merged here."""
    return f"""p AS (SELECT {key}, i, a[i] AS x FROM (SELECT {key}, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT {key},
  string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?…]\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS a FROM {source}))),
h AS (SELECT {key}, i, x, CASE WHEN regexp_matches(lag(x) OVER (PARTITION BY {key} ORDER BY i),
  '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-zÀ-ÿ]|Mme|Mlle|Dr|etc)\\.\\s*$') THEN 0 ELSE 1 END AS head FROM p),
g AS (SELECT *, sum(head) OVER (PARTITION BY {key} ORDER BY i) AS grp FROM h),
r AS (SELECT {key}, grp, trim(string_agg(x, '' ORDER BY i), ' ' || chr(10)) AS x FROM g GROUP BY 1, 2),
s AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY grp) AS i, x FROM r WHERE x <> '')"""


@query("sentence_split_strict", f"WITH {strict_cte('documents')} SELECT doc_id, CAST(i - 1 AS INT) AS n, x AS sentence FROM s")
def _(t):
    cut = ch.sentences_strict(t.documents, "text", "s")
    return numbered_rows(cut, ["doc_id"], "s", "n", "sentence")


@query("sentence_split_legacy", """
SELECT doc_id, CAST(i - 1 AS INT) AS n, trim(a[i]) AS sentence FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i
FROM (SELECT doc_id, string_split(regexp_replace(trim(replace(text, ', ', '… '), ' ' || chr(10)), '([.!?;])\\s+',
  '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents)) WHERE trim(a[i]) <> ''""")
def _(t):
    ellipses = t.documents.withColumn("text", F.replace("text", F.lit(", "), F.lit("… ")))
    cut = ch.sentences_legacy(ellipses, "text", "s")
    return numbered_rows(cut, ["doc_id"], "s", "n", "sentence")


_ELLIPSES = "replace(text, ', ', '… ')"


@query("ellipsis_merge", f"""
WITH p AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id,
  list_filter(list_transform(string_split(replace({_ELLIPSES}, '… ', '…' || chr(1)), chr(1)), lambda z: trim(z)),
    lambda z: z <> '') AS a FROM documents)),
q AS (SELECT doc_id, i, a[i] AS x, coalesce(a[i] LIKE '%…' AND i < len(a) AND
  NOT regexp_matches(a[i + 1], '^[A-ZÀ-Ÿ][a-zà-ÿ]'), false) AS wants FROM p),
-- inside a run of joinable sentences every second one is consumed by the one before
r AS (SELECT *, i - coalesce(max(CASE WHEN NOT wants THEN i END) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM q),
g AS (SELECT *, CASE WHEN k % 2 = 0 THEN i - 1 ELSE i END AS head FROM r)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY head) - 1 AS INT) AS n,
  string_agg(x, ' ' ORDER BY i) AS sentence FROM g GROUP BY doc_id, head""")
def _(t):
    parts = F.filter(F.transform(F.split(F.replace("text", F.lit(", "), F.lit("… ")), "(?<=…) "), tx.strip),
                     lambda z: z != "")
    cut = t.documents.withColumn("__p", parts).withColumn("s", ch.merge_ellipses(F.col("__p"), ch._CAPITAL_WORD))
    return numbered_rows(cut, ["doc_id"], "s", "n", "sentence")


@query("paragraph_repair", f"""WITH {lines_cte()}, p AS (SELECT doc_id, i, trim(x) AS x FROM l WHERE trim(x) <> ''),
f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p),
h AS (SELECT *, CASE WHEN before IS NULL OR (regexp_matches(before, '[.!?…"»”\\)\\]]$') AND NOT list_any_value(
  list_filter([{', '.join(f"'{a}'" for a in ch.PROTECTED)}], lambda a: ends_with(before, a))) IS NOT NULL)
  THEN 1 ELSE 0 END AS opens FROM f),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM h)
SELECT doc_id, CAST(grp - 1 AS INT) AS para_no, string_agg(x, ' ' ORDER BY i) AS text FROM g GROUP BY 1, 2""")
def _(t):
    kept = F.filter(F.transform(tx.lines(F.col("text")), tx.strip), lambda x: x != "")
    fixed = ch.repair_paragraphs(t.documents.withColumn("__p", kept), "__p", "fixed")
    return numbered_rows(fixed, ["doc_id"], "fixed", "para_no", "text")


@query("greedy_pack", f"""WITH RECURSIVE {_sentence_cte('documents')}, {_pack_cte(500)}
SELECT w.doc_id, w.g AS chunk_no, string_agg(s.x, ' ' ORDER BY s.i) AS text FROM w
JOIN s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY 1, 2""")
def _(t):
    cut = t.documents.select("doc_id", ch.sentences(F.col("text")).alias("s"))
    return ch.explode_chunks(ch.pack(cut, "s", "c", 500), ["doc_id"], "c")


@query("smart_lines", f"""WITH RECURSIVE {_sentence_cte('documents')}, {_pack_cte(220)}
SELECT w.doc_id, w.g AS chunk_no, string_agg(s.x, ' ' ORDER BY s.i) AS text FROM w
JOIN s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY 1, 2""")
def _(t):
    cut = t.documents.select("doc_id", ch.sentences(F.col("text")).alias("s"))
    return ch.explode_chunks(ch.pack(cut, "s", "c", 220), ["doc_id"], "c")


_FLAT = ("array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda z: trim(z)), "
         "lambda z: z <> ''), ' ')")


def _valid(abbreviations: tuple[str, ...]) -> str:
    stems = "|".join(a[:-1].replace(".", "\\.") for a in abbreviations)
    tail = "right(left(rest, i + 1), 10)"
    return (f"NOT regexp_matches({tail}, '({stems})\\.$') "
            f"AND NOT regexp_matches({tail}, '(^|[^\\p{{L}}\\p{{N}}_])[A-Za-zÀ-ÿ]\\.$')")


def _prose_cut() -> str:
    """Cut position of the prose chunker, tier by tier, on `rest`."""
    quote = "length(regexp_extract(substr(rest, {p} + 2, 4), '^[ \\x{{A0}}]{{0,3}}[»”\"’'']'))"

    def tier(a: str, b: str) -> str:
        pos = (f"list_max(list_filter(list_filter(range({a}, {b}), lambda i: substr(rest, i + 1, 1) IN ('.', '!', '?')), "
               f"lambda i: {_valid(ch.PROSE_ABBREVIATIONS)}))")
        return f"(SELECT CASE WHEN p + {quote.format(p='p')} > 0 THEN p + {quote.format(p='p')} END FROM (SELECT {pos} AS p))"

    space = "list_max(list_filter(range(400, 500), lambda i: substr(rest, i + 1, 1) = ' '))"
    return (f"coalesce({tier('400', '500')}, {tier('200', '400')}, {tier('500', 'least(length(rest), 650)')}, "
            f"{tier('0', '200')}, {space}, 500)")


def _play_cut() -> str:
    def last(ch_: str) -> str:
        return f"list_max(list_filter(range(250, 400), lambda i: substr(rest, i + 1, 1) = '{ch_}'))"

    quoted = "p + length(regexp_extract(substr(rest, p + 2, 3), '^ {0,2}[»”\"]'))"
    stop = (f"greatest({last('!')}, {last('?')}, list_max(list_filter([{last('.')}], "
            f"lambda i: {_valid(ch.PLAY_ABBREVIATIONS)})))")
    tiers = [f"(SELECT {quoted} FROM (SELECT {p} AS p))" for p in (stop, last(":"), last(","))]
    return f"coalesce({', '.join(tiers)}, {last(' ')}, 400)"


def _cut_cte(source: str, cut: str, high: int, keys: str = "doc_id") -> str:
    """`k(keys, n, chunk, rest)`: cut one chunk per round off the rest of every text."""
    head = ", ".join(f"k.{c.strip()}" for c in keys.split(","))
    return (f"k AS (SELECT {keys}, -1 AS n, '' AS chunk, trim(text) AS rest FROM {source} UNION ALL "
            f"SELECT {keys}, n + 1, trim(left(rest, c + 1)), trim(substr(rest, c + 2)) FROM (SELECT {head}, k.n, k.rest, "
            f"CASE WHEN length(rest) <= {high} THEN length(rest) ELSE {cut} END AS c FROM k WHERE rest <> ''))")


@query("prose_chunks", f"""WITH RECURSIVE d AS (SELECT doc_id, {_FLAT} AS text FROM documents),
{_cut_cte('d', _prose_cut(), 500)} SELECT doc_id, CAST(n AS INT) AS chunk_no, chunk AS text FROM k WHERE chunk <> ''""")
def _(t):
    return numbered_rows(t.documents, ["doc_id"], ch.prose_chunks(ch.flat_text(F.col("text"))), "chunk_no", "text")


#: Every fourth line becomes an all-caps name, so that prose reads like a play.
_NAME_SQL = "CASE (doc_id + i) % 3 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'LE VIEUX BORIS' ELSE 'CLARA' END"


def script_cte() -> str:
    """`l(doc_id, i, x)`: lines of each document with speaker lines put in (i from 1)."""
    return (lines_cte().replace("l AS", "l0 AS", 1)
            + f", l AS (SELECT doc_id, i, CASE WHEN i % 4 = 2 THEN {_NAME_SQL} ELSE x END AS x FROM l0)")


def scripts(t, key: str = "doc_id"):
    """The same derivation for Spark: a `text` column holding the script."""
    i = lambda n: n + 1
    name = lambda n: F.when((F.col(key) + i(n)) % 3 == 0, "ANNA").when(
        (F.col(key) + i(n)) % 3 == 1, "LE VIEUX BORIS").otherwise("CLARA")
    made = F.transform(tx.lines(F.col("text")), lambda x, n: F.when(i(n) % 4 == 2, name(n)).otherwise(x))
    return t.documents.select(key, F.array_join(made, "\n").alias("text"))


_RUNS = f"""{script_cte()},
f AS (SELECT *, CASE WHEN x = upper(x) AND x <> lower(x) AND len(list_filter(string_split_regex(x, '\\s+'),
  lambda z: z <> '')) BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS head FROM l),
g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM f),
runs AS (SELECT doc_id, grp, max(x) FILTER (head = 1) AS speaker,
  trim(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (head = 0), '')) AS text FROM g WHERE grp > 0 GROUP BY 1, 2)"""


@query("speaker_runs", f"""WITH {_RUNS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INT) AS run_no, speaker, text FROM runs
WHERE text <> ''""")
def _(t):
    runs = ch.speaker_runs(scripts(t), "text", "r")
    return numbered_rows(runs, ["doc_id"], "r", "run_no", "r").select("doc_id", "run_no", "r.*")


@query("play_chunks", f"""WITH RECURSIVE {_RUNS}, {_cut_cte('runs', _play_cut(), 400, 'doc_id, grp, speaker')}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, n) - 1 AS INT) AS chunk_no, speaker,
  chunk AS text FROM k WHERE chunk <> ''""")
def _(t):
    return ch.play_run_chunks(scripts(t), "text", ["doc_id"])


@query("attribution_chunks", f"""WITH RECURSIVE u AS (SELECT doc_id, list_filter(list_transform(string_split_regex(
  replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\\n\\s*\\n'), lambda z: trim(z, ' ' || chr(10))),
  lambda z: z <> '') AS a, text FROM documents),
v AS (SELECT doc_id, CASE WHEN len(a) <= 1 THEN list_filter(list_transform(string_split(text, chr(10)), lambda z: trim(z)),
  lambda z: z <> '') ELSE a END AS a FROM u),
pp AS (SELECT doc_id, p, a[p] AS x FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS p FROM v)),
long AS (SELECT doc_id, p, string_split(regexp_replace(x, '([.!?…»"])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS b FROM pp
  WHERE length(x) > 2000),
ls AS (SELECT doc_id, p, j, b[j] AS x FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM long)),
lw AS (SELECT doc_id, p, j, length(x) AS len, 0 AS g FROM ls WHERE j = 1 UNION ALL SELECT ls.doc_id, ls.p, ls.j,
  CASE WHEN lw.len + 1 + length(ls.x) <= 2000 THEN lw.len + 1 + length(ls.x) ELSE length(ls.x) END,
  lw.g + CASE WHEN lw.len + 1 + length(ls.x) <= 2000 THEN 0 ELSE 1 END
  FROM lw JOIN ls ON ls.doc_id = lw.doc_id AND ls.p = lw.p AND ls.j = lw.j + 1),
unit AS (SELECT doc_id, p, 0 AS g, x FROM pp WHERE length(x) <= 2000 UNION ALL
  SELECT lw.doc_id, lw.p, lw.g, string_agg(ls.x, ' ' ORDER BY ls.j) FROM lw JOIN ls USING (doc_id, p, j) GROUP BY 1, 2, 3),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, g) AS i, x FROM unit),
{_pack_cte(2000, 2)}
SELECT w.doc_id, w.g AS chunk_no, string_agg(s.x, chr(10) || chr(10) ORDER BY s.i) AS text FROM w
JOIN s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY 1, 2""")
def _(t):
    docs = t.documents.selectExpr("doc_id", "replace(text, '.\\n', '.\\n\\n') AS text")
    return ch.explode_chunks(ch.attribution_chunks(docs, "text", "c"), ["doc_id"], "c")


def _long_form_cut() -> str:
    """Cut position of the long-form chunker on `rest`; the given texts hold no `[tag]`."""
    plain = "|".join(a for a in ch.LONG_FORM_ABBREVIATIONS if "." not in a)
    head = "right(left(rest, i), 40)"
    at_end = "(i = 799 OR regexp_matches(substr(rest, i + 2, 1), '^\\s$'))"
    stop = (f"list_max(list_filter(list_filter(range(0, 800), lambda i: substr(rest, i + 1, 1) IN ('.', '!', '?')), "
            f"lambda i: {at_end} AND (substr(rest, i + 1, 1) <> '.' OR NOT (regexp_matches({head}, "
            f"'(?i)(^|[^\\p{{L}}])({plain})$') OR regexp_matches({head}, '[0-9]\\p{{L}}*$')))))")
    clause = (f"list_max(list_filter(list_filter(range(0, 800), lambda i: substr(rest, i + 1, 1) IN (';', ':', ',', '—')), "
              f"lambda i: {at_end}))")
    space = "list_max(list_filter(range(0, 800), lambda i: substr(rest, i + 1, 1) = ' '))"
    return f"coalesce({stop}, {clause}, {space}, 799)"


@query("long_form_chunks", f"""WITH RECURSIVE d AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS text FROM documents),
k AS (SELECT doc_id, -1 AS n, '' AS chunk, text AS rest FROM d UNION ALL SELECT doc_id, n + 1, trim(left(rest, c + 1), ' ' || chr(10)),
  ltrim(substr(rest, c + 2), ' ' || chr(10)) FROM (SELECT k.doc_id, k.n, k.rest, CASE WHEN length(rest) <= 800 THEN length(rest)
  ELSE {_long_form_cut()} END AS c FROM k WHERE rest <> ''))
SELECT doc_id, CAST(n AS INT) AS chunk_no, chunk AS text FROM k WHERE chunk <> ''""")
def _(t):
    return numbered_rows(t.documents, ["doc_id"], ch.long_form_chunks()(F.col("text")), "chunk_no", "text")


@query("line_segments", f"""WITH {lines_cte()}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS num, 'Narrator' AS profile_id,
  trim(x) AS text FROM l WHERE trim(x) <> ''""")
def _(t):
    return ch.line_segments(t.documents, "text", ["doc_id"])


@query("paragraph_segments", """
WITH p AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split_regex(
  replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\\n\\s*\\n') AS a FROM documents)),
c AS (SELECT doc_id, i, array_to_string(list_filter(list_transform(string_split(a[i], chr(10)), lambda z: trim(z)),
  lambda z: z <> ''), ' ') AS x FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS num, x AS text FROM c WHERE x <> ''""")
def _(t):
    docs = t.documents.selectExpr("doc_id", "replace(text, '.\\n', '.\\n \\n') AS text")
    return ch.paragraph_segments(docs, "text", ["doc_id"])


@query("pair_segments", f"""WITH d AS (SELECT doc_id, replace(text, 'ß', 'ss') AS text FROM documents), {lines_cte('d')},
m AS (SELECT doc_id, i, CASE WHEN i % 4 = 1 THEN 'didas' WHEN i % 4 = 2 THEN concat('(', trim(x), ')') ELSE trim(x) END
  AS x FROM l WHERE trim(x) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM m),
p AS (SELECT doc_id, CAST(k // 2 + 1 AS INT) AS num, max(x) FILTER (k % 2 = 0) AS s, max(x) FILTER (k % 2 = 1) AS b
  FROM n GROUP BY 1, 2)
SELECT doc_id, num, upper(s) AS profile_id, CASE WHEN upper(s) = 'DIDAS' AND starts_with(b, '(') AND ends_with(b, ')')
  THEN trim(substr(b, 2, length(b) - 2)) ELSE b END AS text FROM p WHERE b IS NOT NULL""")
def _(t):
    plain = t.documents.withColumn("text", F.replace("text", F.lit("ß"), F.lit("ss")))
    made = F.transform(tx.lines(F.col("text")), lambda x, n: F.when((n + 1) % 4 == 1, F.when(
        tx.strip(x) != "", "didas").otherwise("")).when((n + 1) % 4 == 2, F.when(
            tx.strip(x) != "", F.concat(F.lit("("), tx.strip(x), F.lit(")"))).otherwise("")).otherwise(x))
    return ch.pair_segments(plain.select("doc_id", F.array_join(made, "\n").alias("text")), "text", ["doc_id"])


@query("chunk_statistics", f"""WITH RECURSIVE {_sentence_cte('documents', keys='doc_id, source')}, {_pack_cte(500)},
c AS (SELECT s.source, w.doc_id, w.g, length(string_agg(s.x, ' ' ORDER BY s.i)) AS n FROM w
  JOIN s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY 1, 2, 3)
SELECT source, count(*) AS chunks, CAST(round(avg(n)) AS BIGINT) AS mean_chars, max(n) AS max_chars,
  count(*) FILTER (n > 500) AS over_limit FROM c GROUP BY 1""")
def _(t):
    cut = t.documents.select("source", ch.sentences(F.col("text")).alias("s"))
    return ch.chunk_statistics(ch.explode_chunks(ch.pack(cut, "s", "c", 500), ["source"], "c"), ["source"], 500)


@query("chunk_seeds", f"""WITH RECURSIVE {_sentence_cte('documents')}, {_pack_cte(500)}
SELECT doc_id, g AS chunk_no, 1234 + g AS seed FROM w GROUP BY 1, 2""")
def _(t):
    cut = t.documents.select("doc_id", ch.sentences(F.col("text")).alias("s"))
    return ch.numbered_seeds(ch.explode_chunks(ch.pack(cut, "s", "c", 500), ["doc_id"], "c"), 1234).drop("text")


@query("corpus_to_chunks", f"""WITH RECURSIVE {lines_cte()},
r AS (SELECT doc_id, i, x, {_R} AS y FROM l),
n AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY i) AS text FROM r
  WHERE NOT (trim(x) <> '' AND trim(y, ' ' || chr(10)) = '') GROUP BY 1),
{_sentence_cte('n')}, {_pack_cte(500)},
c AS (SELECT w.doc_id, w.g, length(string_agg(s.x, ' ' ORDER BY s.i)) AS n FROM w
  JOIN s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY 1, 2)
SELECT d.source, count(*) AS chunks, CAST(round(avg(c.n)) AS BIGINT) AS mean_chars, max(c.n) AS max_chars,
  count(*) FILTER (c.n > 500) AS over_limit FROM c JOIN documents d USING (doc_id) GROUP BY 1""")
def _(t):
    normal = F.array_join(tx.apply_rules_to_lines(tx.lines(F.col("text")), RULES), "\n")
    cut = t.documents.select("source", normal.alias("text")).select("source", ch.sentences(F.col("text")).alias("s"))
    chunks = ch.explode_chunks(ch.pack(cut, "s", "c", 500), ["source"], "c")
    return ch.chunk_statistics(chunks, ["source"], 500)
