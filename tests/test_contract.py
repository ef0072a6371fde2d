"""The driver contract, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"


def test_entry_has_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["source", "chunks", "mean_chars", "max_chars", "over_limit"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 150


@pytest.mark.parametrize("name", [
    "history_page", "sequential_start_times", "line_rules", "greedy_pack", "play_parse", "anomaly_queue",
    "take_selection_slots", "throttled_progress", "runaway_labels", "overlap_mix", "markup_blocks",
    "stream_client_last_seen"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from lectern.plans.domain import TABLES
    from tests.oracle_check import compare

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    assert compare(spark, con, name, SMALL).startswith("ok")


@pytest.mark.parametrize("hidden", ["xxhash", "lectern.llm"])
def test_queries_survive_what_cannot_be_imported(hidden):
    code = (f"import sys; sys.modules['{hidden}'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) > 220 and 'history_page' in q and not any(n.startswith('op') for n in q); "
            "assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
