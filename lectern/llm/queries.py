"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import (hard_negatives, html_text, jaccard_join, line_dedup, mixing, periodic_runs, piece_codec,
                         quality_rules, secrets, sharding, token_store, topk, toxicity)
from lectern.llm.common import WORD, table, tokenizer_path
from lectern.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_secret_scan")
def _(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


_RULES = "symbols equal_lines repeats capitals exclamations".split()
_PARTS = {"symbols": ("n_symbols", "word_chars"), "equal_lines": ("n_dup_lines", "n_lines"),
          "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars"),
          "exclamations": ("n_exclamations", "n_words")}
_LEVELS = ", ".join(f"CASE WHEN {a} > 0 AND {b} > 0 THEN least(19, (20 * {a} - 1) // {b}) ELSE 0 END AS {r}"
                    for r, (a, b) in _PARTS.items())
_COUNTS = " UNION ALL ".join(
    f"SELECT stratum, '{r}' AS rule, c, count(*) AS n, count(*) FILTER ({r} >= c) AS k FROM good, range(1, 20) t(c) "
    "GROUP BY ALL" for r in _RULES)
_CUTS = ", ".join(f"max(cut) FILTER (rule = '{r}') AS cut_{r}" for r in _RULES)
_OVER = " OR ".join(f"coalesce({r} >= cut_{r}, false)" for r in _RULES)


@query("op2_quality_rules", f"""WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
q AS (SELECT id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT id, i, a, lead(a) OVER y AS b, lead(a, 2) OVER y AS e FROM q WINDOW y AS (PARTITION BY id ORDER BY i)),
h AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, e) AS times FROM g WHERE e IS NOT NULL),
r AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE times > 1) GROUP BY id),
m AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
    length(t) - length(replace(t, '!', '')) AS n_exclamations FROM d LEFT JOIN r USING (id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_LEVELS} FROM m),
good AS (SELECT v.* FROM v JOIN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL
  GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
c AS ({_COUNTS}),
p AS (SELECT *, CASE WHEN k > n * {quality_rules.RISK / 5}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK / 5}::DOUBLE)
      + (n - i) * ln(1 - {quality_rules.RISK / 5}::DOUBLE)))) END AS tail,
    (SELECT count(DISTINCT (stratum, rule)) FROM c) AS tests FROM c),
f AS (SELECT *, bool_and(tail <= {quality_rules.MISS} / tests) OVER (PARTITION BY stratum, rule ORDER BY c DESC) AS passed FROM p),
u AS (SELECT stratum, rule, min(c) AS cut FROM f WHERE passed GROUP BY ALL),
x AS (SELECT stratum, {_CUTS} FROM u GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_OVER}) AS kept FROM v LEFT JOIN x USING (stratum)""")
def _(spark, sf_dir):
    return quality_rules.rule_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_jaccard_join")
def _(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_sharding")
def _(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op5_token_files")
def _(spark, sf_dir):
    return token_store.token_report(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_toxicity")
def _(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_piece_codec")
def _(spark, sf_dir):
    return piece_codec.codec_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op8_mixing", f"""WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS stray,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
k AS (SELECT *, -ln((CAST(('0x' || substr(mark, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / CASE WHEN size > 0 THEN size / (size + stray)::DOUBLE ELSE 1 END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
c AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST) AS i FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights FROM c),
v AS (SELECT *, (1.5::DOUBLE * total - caps) / (all_weights - weights)::DOUBLE AS level FROM b),
l AS (SELECT arg_min(level, i) AS level FROM v WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(v.weight * l.level, cap::DOUBLE)) AS target FROM v, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(floor(target - epochs * source_size + 0.5::DOUBLE) AS BIGINT) AS rest FROM e),
o AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT o.doc_id, o.size, r.source_size, r.target, CAST(r.epochs * o.size
    + greatest(0, least(o.size, r.rest - o.before)) AS BIGINT) AS taken
FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source""")
def _(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op9_html_text")
def _(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_top_k", """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def _(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op11_hard_negatives", """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
    ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved))


@query("op12_line_dedup", """WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT id, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
c AS (SELECT key, min(doc_id) AS home FROM k WHERE length(key) >= 10 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.home AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY id""")
def _(spark, sf_dir):
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def _(spark, sf_dir):
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
