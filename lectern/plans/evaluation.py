"""Transcript evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evaluation as ev
from lectern.plans.registry import ORACLES, query

# Loops, fillers and short answers are put into the given turns by plain replacements.
_RAW = ("CASE WHEN turn % 3 = 0 THEN concat(text, repeat(' URL,', 6 + CAST(turn AS INT)), ' fin') "
        "WHEN turn % 3 = 1 THEN replace(replace(text, ' de ', ' um '), ' la ', ' you know ') ELSE text END")
_REFINED = ("CASE WHEN turn % 5 = 0 THEN concat('Sure, here it is. ', text) WHEN turn % 5 = 1 THEN translate(text, ' bcdefghijklmnopqrstuvwxyz', '') "
            "WHEN turn % 5 = 2 THEN concat(text, repeat(' non', 7)) WHEN turn % 5 = 3 THEN concat(text, ' um ', text) "
            "ELSE concat(text, '?') END")

_TOKENS = """tok AS (SELECT id, i, w[i] AS w, lower(regexp_replace(w[i], '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS k, len(w) AS n
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id * 100 + turn AS id, list_filter(string_split_regex(
  {text}, '\\s+'), lambda z: z <> '') AS w FROM conversations))),
isl AS (SELECT *, sum(CASE WHEN k = '' OR p IS NULL OR p <> k THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g
  FROM (SELECT *, lag(k) OVER (PARTITION BY id ORDER BY i) AS p FROM tok)),
run AS (SELECT *, count(*) OVER (PARTITION BY id, g) AS len FROM isl)"""


@query("word_loop_collapse", f"""WITH {_TOKENS.format(text=_RAW)}
SELECT c.conv_id * 100 + c.turn AS id, CASE WHEN coalesce(r.n, 0) < 6 THEN {_RAW} ELSE coalesce(r.t, '') END AS text
FROM conversations c LEFT JOIN (SELECT id, max(n) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT (len >= 6 AND k <> '')) AS t
  FROM run GROUP BY 1) r ON r.id = c.conv_id * 100 + c.turn""")
def _(t):
    raw = t.turns.selectExpr("conv_id * 100 + turn AS id", f"{_RAW} AS text")
    return ev.collapse_word_loops(raw, "text", "out").select("id", F.col("out").alias("text"))


@query("character_loop_collapse")
def _(t):
    looped = t.documents.select("doc_id", F.concat("text", F.repeat(F.lit("thanks for watching "), F.lit(6))).alias("x"))
    return looped.select("doc_id", ev.collapse_character_loops(F.col("x")).alias("text"))


# Runs of characters equal to the one p places on; a loop begins where five units of p are left; leftmost, then shortest.
_DROPPED = """ch AS (SELECT id, i, substr(text, i, 1) AS c FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM src)),
same AS (SELECT a.id, r.p, a.i FROM ch a, range(2, 61) r(p), ch b WHERE b.id = a.id AND b.i = a.i + r.p AND b.c = a.c),
runs AS (SELECT id, p, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS g
  FROM same) GROUP BY id, p, g HAVING count(*) >= 5 * p),
cand AS (SELECT id, i, arg_min(i + p * (1 + (b - i) // p), p) AS fin FROM (SELECT *, unnest(range(a, b - 5 * p + 1)) AS i FROM runs)
  GROUP BY id, i),
hop AS (SELECT id, min(i) AS i, arg_min(fin, i) AS fin FROM cand GROUP BY id UNION ALL
  SELECT h.id, min(c.i), arg_min(c.fin, c.i) FROM hop h JOIN cand c ON c.id = h.id AND c.i >= h.fin GROUP BY h.id, h.fin),
gone AS (SELECT id, unnest(range(i, fin)) AS i FROM hop),
kept AS (SELECT id, string_agg(c, '' ORDER BY i) AS t FROM ch ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT id, CASE WHEN id IN (SELECT id FROM hop) THEN trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g')) ELSE text END AS text
FROM src LEFT JOIN kept USING (id)"""
_LOOPED = ("CASE turn % 4 WHEN 0 THEN concat(text, repeat('thanks for watching ', 6 + CAST(turn AS INT))) "
           "WHEN 1 THEN concat(repeat('謝謝觀看', 7), text) "
           "WHEN 2 THEN concat(text, repeat('ab', 20), 'abc', repeat('xyzw-', 8), text) ELSE text END")


@query("character_loops_in_turns", f"""WITH RECURSIVE src AS (SELECT conv_id * 100 + turn AS id, {_LOOPED} AS text FROM conversations),
{_DROPPED}""")
def _(t):
    raw = t.turns.selectExpr("conv_id * 100 + turn AS id", f"{_LOOPED} AS text")
    return raw.select("id", ev.collapse_character_loops(F.col("text")).alias("text"))


@query("loop_collapse", f"""WITH RECURSIVE src AS ({ORACLES['word_loop_collapse']}), {_DROPPED}""")
def _(t):
    raw = t.turns.selectExpr("conv_id * 100 + turn AS id", f"{_RAW} AS text")
    return ev.collapse_loops(raw, "text", "out").select("id", F.col("out").alias("text"))


@query("loop_detector", f"""WITH {_TOKENS.format(text=_REFINED)}
SELECT c.conv_id * 100 + c.turn AS id, coalesce(max(CASE WHEN r.len >= 6 AND r.k <> '' THEN 1 ELSE 0 END), 0) = 1 AS looped
FROM conversations c LEFT JOIN run r ON r.id = c.conv_id * 100 + c.turn GROUP BY 1""")
def _(t):
    refined = t.turns.selectExpr("conv_id * 100 + turn AS id", f"{_REFINED} AS text")
    return ev.detect_loops(refined, "text", "looped").select("id", "looped")


_CARD_COLUMNS = ["conv_id", "turn", "concat('model-', conv_id % 4) AS model", "turn * 97 + conv_id AS latency_ms",
                 "turn % 4 = 1 AS keep_question_mark", "true AS must_not_loop"]


def _cards(t):
    plain = ("CASE WHEN turn % 3 = 1 THEN replace(replace(text, ' de ', ' um '), ' la ', ' you know ') ELSE text END")
    c = t.turns.selectExpr(*_CARD_COLUMNS, f"{plain} AS raw", f"{_REFINED} AS refined",
                                   "array('die', 'la', 'Enter') AS must_contain")
    return ev.refinement_scores(c)


_FILL = " + ".join(
    f"len(regexp_extract_all(dd({{c}}), '(?:^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])"
    f"{w.replace(' ', '  ')}(?:[^\\p{{{{L}}}}\\p{{{{N}}}}_]|$)'))" for w in ev.FILLERS)


def _doubled(c: str) -> str:
    """Every separator twice, so that neighbouring whole words do not share one."""
    return f"regexp_replace(lower({c}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"


def _fill(c: str) -> str:
    return _FILL.format(c=c).replace(f"dd({c})", _doubled(c))


# Loops of six words are the only loops in these raw texts, so the cleaned length needs no back reference.
_CARDS = f"""src AS (SELECT conv_id, turn, concat('model-', conv_id % 4) AS model, turn * 97 + conv_id AS latency_ms,
  turn % 4 = 1 AS keep_q, CASE WHEN turn % 3 = 1 THEN replace(replace(text, ' de ', ' um '), ' la ', ' you know ')
  ELSE text END AS raw, {_REFINED} AS refined FROM conversations),
card AS (SELECT *, CAST({_fill('raw')} AS INT) AS fr, CAST({_fill('refined')} AS INT) AS ff,
  CASE WHEN turn % 5 = 0 THEN 'Sure, here' END AS leak, turn % 5 = 2 AS looped,
  list_filter(['die', 'la', 'Enter'], lambda n: NOT contains(lower(refined), lower(n))) AS missing,
  keep_q AND NOT ends_with(trim(refined, ' ' || chr(10)), '?') AS lost_q FROM src)"""


@query("refinement_filler_counts", f"""WITH {_CARDS}
SELECT conv_id, turn, fr AS fillers_raw, ff AS fillers_refined, leak AS prompt_leak, looped AS has_loop,
  array_to_string(missing, ',') AS missing, lost_q AS lost_question FROM card""")
def _(t):
    return _cards(t).select("conv_id", "turn", "fillers_raw", "fillers_refined", "prompt_leak", "has_loop",
                            F.array_join("missing", ",").alias("missing"), "lost_question")


# No word stands six times in a row in these raw texts; repeated units of signs are dropped as above.
@query("refinement_scorecard", f"""WITH RECURSIVE {_CARDS.replace("src", "given")}, w AS (SELECT conv_id * 100 + turn AS id, * FROM card),
src AS (SELECT id, raw AS text FROM w), clean AS (WITH RECURSIVE {_DROPPED}),
s AS (SELECT w.*, length(refined) / greatest(length(c.text), 1) AS ratio FROM w JOIN clean c USING (id))
SELECT conv_id, turn, model, round(ratio, 4) AS length_ratio, concat_ws('; ',
  CASE WHEN leak IS NOT NULL THEN concat('prompt-leak(''', leak, ''')') END, CASE WHEN looped THEN 'loop-echo' END,
  CASE WHEN len(missing) > 0 THEN concat('lost-terms=[', array_to_string(list_transform(missing, lambda m:
    concat('''', m, '''')), ', '), ']') END, CASE WHEN lost_q THEN 'question→statement' END,
  CASE WHEN fr > 0 AND ff >= fr THEN concat('fillers-not-removed(', fr, '→', ff, ')') END,
  CASE WHEN ratio < {ev.TOO_SHORT} THEN printf('too-short(%.2f)', ratio) END,
  CASE WHEN ratio > {ev.TOO_LONG} THEN printf('too-long(%.2f)', ratio) END) AS flags FROM s""")
def _(t):
    return _cards(t).select("conv_id", "turn", "model", F.round("length_ratio", 4).alias("length_ratio"),
                            F.array_join("flags", "; ").alias("flags"))


_PERSONA = ("CASE turn % 6 WHEN 0 THEN concat('Here is a reply: ', text) WHEN 1 THEN concat('*smiles* ', text, ' (leans in)') "
            "WHEN 2 THEN concat(text, ' I cannot do that.') WHEN 3 THEN ' ' ELSE text END")


@query("persona_scorecard", f"""WITH p AS (SELECT conv_id, turn, {_PERSONA} AS refined FROM conversations),
s AS (SELECT *, CASE WHEN turn % 6 = 0 THEN 'Here is a' END AS leak, CASE WHEN turn % 6 = 2 THEN 'I cannot' END AS refusal,
  regexp_extract_all(refined, '[\\*\\(_].{{0,60}}?[\\*\\)_]')[1:3] AS dirs FROM p)
SELECT conv_id, turn, concat_ws('; ', CASE WHEN trim(refined) = '' THEN 'empty-output' END,
  CASE WHEN leak IS NOT NULL THEN concat('prompt-leak(''', leak, ''')') END,
  CASE WHEN refusal IS NOT NULL THEN concat('refusal(''', refusal, ''')') END,
  CASE WHEN len(dirs) > 0 THEN concat('stage-directions=[', array_to_string(list_transform(dirs, lambda d:
    concat('''', d, '''')), ', '), ']') END) AS flags FROM s""")
def _(t):
    p = t.turns.selectExpr("conv_id", "turn", f"{_PERSONA} AS refined")
    return ev.persona_scores(p).select("conv_id", "turn", F.array_join("flags", "; ").alias("flags"))


@query("evaluation_rollup", """
SELECT concat('model-', event_id % 4) AS model, count(*) FILTER (event_type <> 'error') AS clean, count(*) AS total,
  CAST(floor(sum(event_id % 977) / count(*)) AS BIGINT) AS mean_latency_ms FROM events GROUP BY 1""")
def _(t):
    flags = F.when(F.col("event_type") == "error", F.array(F.lit("loop-echo"))).otherwise(
        F.array().cast("array<string>"))
    return ev.model_rollup(t.events.select(
        F.concat(F.lit("model-"), (F.col("event_id") % 4).cast("string")).alias("model"), flags.alias("flags"),
        (F.col("event_id") % 977).alias("latency_ms")))
