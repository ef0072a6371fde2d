"""Domain tables as views of the given tables.

Every view is one projection, written in SQL that Spark and DuckDB read alike,
so the mapping is stated once and used by both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.tables import read_table, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

#: Tables whose rows are costly to process, with the key that spreads them.
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}

_ITEM_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "profiles": ("customer", [
        "c_custkey AS id", "c_name AS name", "lower(c_mktsegment) AS language",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('Voice for ', c_mktsegment) END AS description",
        "c_nationkey AS channel_id",
    ]),
    "generations": ("orders", [
        "o_orderkey AS id", "o_custkey AS profile_id", "concat('Take ', o_orderpriority) AS text",
        "o_totalprice / 1000 AS duration",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'generating' ELSE 'failed' END AS status",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'luxtts' ELSE 'qwen' END AS engine",
        "o_orderkey % 7 = 0 AS is_favorited", "o_orderdate AS created_at",
        "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('generations/', o_orderkey, '.wav') END AS audio_path",
    ]),
    "versions": ("lineitem", [
        f"{_ITEM_ID} AS id", "l_orderkey AS generation_id", "concat('v', l_linenumber) AS label",
        "l_returnflag = 'R' AS is_default", "l_shipdate AS created_at",
        f"concat('versions/', {_ITEM_ID}, '.wav') AS audio_path",
        "CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'reverb' END AS effects_chain",
    ]),
    "items": ("lineitem", [
        f"{_ITEM_ID} AS id", "l_suppkey AS story_id", "l_orderkey AS generation_id",
        f"CASE l_partkey % 3 WHEN 0 THEN {_ITEM_ID} WHEN 1 THEN concat('gone-', l_partkey) END AS version_id",
        "l_orderkey * 10 + l_linenumber AS position", "l_quantity + l_tax AS duration",
        "CAST(floor(l_extendedprice) AS BIGINT) AS start_time_ms", "l_linenumber % 3 AS track",
        "CAST(round(l_discount * 10000) AS BIGINT) AS trim_start_ms",
        "CAST(round(l_tax * 10000) AS BIGINT) AS trim_end_ms",
        "CASE WHEN l_partkey % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS volume",
    ]),
    "stories": ("orders", [
        "o_orderkey AS id", "concat('Story ', o_orderkey % 100) AS name",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS description",
        "o_orderdate AS updated_at",
    ]),
    "samples": ("part", [
        "p_partkey AS id", "p_partkey * 3 % 1500 AS profile_id", "p_name AS reference_text",
    ]),
    "segments": ("conversations", [
        "conv_id AS project", "CAST(turn + 1 AS INT) AS num", "upper(role) AS profile_id", "text",
        "CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE concat('Voice ', (conv_id * 7 + turn) % 10) END "
        "AS generated_voice",
        "CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE ((conv_id * 37 + turn * 11) % 1000) / CAST(1000 AS DOUBLE) "
        "END AS qc_score",
        "((conv_id * 13 + turn * 7) % 120) / CAST(10 AS DOUBLE) AS qc_duration",
        "CASE WHEN turn % 4 = 0 THEN NULL ELSE CAST(turn % 2 AS INT) END AS read",
        "CASE WHEN (conv_id + turn) % 11 = 0 THEN 'forced' WHEN (conv_id + turn) % 13 = 0 THEN 'force_refused' "
        "WHEN (conv_id + turn) % 17 = 0 THEN 'accepted' END AS qc_status",
        "(conv_id + turn) % 5 <> 0 AS has_audio",
    ]),
    "takes": ("conversations", [
        "conv_id AS project", "CAST(turn + 1 AS INT) AS num",
        "CASE WHEN turn % 3 = 0 THEN 'main' ELSE concat('v', (conv_id + turn) % 12) END AS version",
    ]),
    "voices": ("embeddings", [
        "vec_id AS ord", "concat('Voice ', label) AS name", "concat('vp-', label) AS voice_id",
    ]),
    "slices": ("embeddings", [
        "label AS voice", "vec_id AS ord",
        "CASE vec_id % 6 WHEN 0 THEN '0.5' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '5' "
        "ELSE 'full' END AS slice",
        "CASE vec_id % 6 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(2 AS DOUBLE) "
        "WHEN 3 THEN CAST(3 AS DOUBLE) WHEN 4 THEN CAST(5 AS DOUBLE) ELSE CAST(8 AS DOUBLE) END AS ref_sec",
        "embedding AS emb",
    ]),
    "attempts": ("embeddings", [
        "label AS voice", "CAST(vec_id % 50 AS INT) AS num", "CAST(vec_id % 2 AS INT) AS slot",
        "CAST(vec_id AS INT) AS attempt", "(vec_id % 120) / CAST(10 AS DOUBLE) AS duration",
        "vec_id % 23 <> 0 AS ok", "embedding AS emb",
    ]),
    "clients": ("supplier", [
        "s_suppkey AS client_id", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey * 2 END AS profile_id",
    ]),
    "requests": ("events", [
        "event_id", "ts", "user_id AS client_id",
        "CASE event_type WHEN 'signup' THEN '/mcp' WHEN 'error' THEN '/mcpx' WHEN 'click' THEN '/speak/now' "
        "WHEN 'view' THEN '/health' ELSE '/mcp/tools' END AS path",
        "CASE WHEN event_id % 3 = 0 THEN concat('Customer#', lpad(CAST(event_id % 2000 AS STRING), 9, '0')) END "
        "AS explicit_voice",
    ]),
    "progress": ("events", [
        "concat('model-', user_id % 7) AS key", "event_id", "event_id * 87 + (user_id * 31) % 80 AS at_ms",
        "CAST(floor(event_id / 10) AS BIGINT) % 1000 AS current",
        "CASE WHEN event_id % 131 = 0 THEN 0 ELSE 1000 END AS total",
        "CASE WHEN event_id % 97 = 0 THEN 'complete' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'error' "
        "WHEN event_type = 'view' THEN 'extracting' ELSE 'downloading' END AS status",
    ]),
    "speed_samples": ("events", [
        "concat('server-', user_id % 2) AS queue", "event_type AS engine",
        "CASE WHEN event_id % 3 = 0 THEN '0.6B' ELSE '1.7B' END AS model", "event_id", "ts", "event_id % 40 AS chars",
        "CASE WHEN event_id % 53 = 0 THEN value * 10000 ELSE value * 100 END AS duration_ms", "event_id % 9 <> 0 AS ok",
    ]),
    "log_lines": ("events", [
        "event_type AS queue", "event_id", "ts",
        "CASE event_id % 4 WHEN 0 THEN concat('[QC] Tentative ', 1 + user_id % 5, '/20 — segment 7...') "
        "WHEN 1 THEN concat('[QC] Insuffisant (Meilleur : ', user_id, '%) — nouvelle tentative...') "
        "WHEN 2 THEN concat('[QC] Version 1/2 — tentative ', 1 + user_id % 3, ' /20 (meilleur : ', "
        "CASE WHEN user_id % 2 = 0 THEN '—' ELSE CAST(user_id AS STRING) END, '%)') ELSE 'other' END AS line",
    ]),
    "artifacts": ("documents", [
        "source AS project", "doc_id", "n_chars AS size",
        "concat(CASE WHEN doc_id % 13 = 0 THEN 'backup_' WHEN doc_id % 17 = 0 THEN 'seg' ELSE 'book' END, doc_id, "
        "CASE doc_id % 5 WHEN 0 THEN '_formated' WHEN 1 THEN '_parsed' WHEN 2 THEN '_chunked' ELSE '' END, '.txt') "
        "AS name",
    ]),
}


def ctes(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for DuckDB, from the same projections."""
    parts = [f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


class Domain:
    """Lazy access to the given tables and to the views above."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    @property
    def turns(self) -> DataFrame:
        """Conversation turns spread over all cores, for jobs that do much work per turn."""
        return spread(self.conversations, "conv_id", "turn")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            table = read_table(self.spark, self.sf_dir, name)
            return spread(table, _TEXT_TABLES[name]) if name in _TEXT_TABLES else table
        if name in VIEWS:
            source, columns = VIEWS[name]
            return getattr(self, source).selectExpr(*columns)
        raise AttributeError(name)
