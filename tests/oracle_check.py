"""Run the registered queries next to their DuckDB text and compare.

    python tests/oracle_check.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from lectern.plans.domain import TABLES  # noqa: E402
from lectern.session import build_session  # noqa: E402

_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp", "FLOAT": "float", "DATE": "date",
}


def canonical(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def compare(spark, con, name: str, sf_dir: str) -> str:
    start = time.time()
    df = contract.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(canonical(v) for v in r) for r in df.select(*cols).collect())
    took = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(rows)} rows {took:.2f}s"
    start = time.time()
    rel = con.sql(sql)
    theirs = rel.columns
    kinds = dict(zip(theirs, [str(t) for t in rel.types]))
    data = rel.fetchall()
    slow = time.time() - start
    if sorted(theirs) != cols:
        return f"FAIL columns {cols} vs {sorted(theirs)}"
    ours = dict(df.dtypes)
    for c in cols:
        mine = ours[c].replace("timestamp_ntz", "timestamp")
        if _TYPES.get(kinds[c]) != mine:
            return f"FAIL type of {c}: {mine} vs {kinds[c]}"
    pick = [theirs.index(c) for c in cols]
    expected = sorted(tuple(canonical(r[i]) for i in pick) for r in data)
    if rows != expected:
        extra = [r for r in rows if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(rows)][:3]
        return f"FAIL {len(rows)} vs {len(expected)} rows\n   cols  {cols}\n   spark {extra}\n   duck  {missing}"
    note = " (empty)" if not rows else ""
    return f"ok {len(rows)} rows{note} {took:.2f}s (sql {slow:.2f}s)"


def main(argv: list[str]) -> int:
    import duckdb

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check", master="local[8]", shuffle=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in contract.queries():
        if argv and not any(a in name for a in argv):
            continue
        try:
            outcome = compare(spark, con, name, sf_dir)
        except Exception as err:  # report and go on with the next query
            outcome = "FAIL " + str(err)[:1500]
        bad += outcome.startswith("FAIL")
        print(f"{name}: {outcome}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
