"""Run a registered query and its oracle on the same tables and compare all values.

python -m tests.compare [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tidegrid.plans import ORACLES, QUERIES
from tidegrid.plans.fixtures import TABLES

DATA = "/root/testdata"


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in sorted(value.items())}
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


# fixed values: type names that mean the same
SAME = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP", "int": "INTEGER"}


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    frame = QUERIES[name](spark, sf_dir)
    rows = frame.collect()
    took = time.time() - start
    if name not in ORACLES:
        return len(rows) > 0, f"{len(rows)} rows, no oracle, {took:.1f}s"
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    expected = answer.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} against {sorted(names)}"
    kinds = dict(zip(names, (str(d[1]) for d in answer.description)))
    odd = [
        f"{f.name}: {f.dataType.simpleString()}/{kinds[f.name]}" for f in frame.schema
        if SAME.get(f.dataType.simpleString(), kinds[f.name]) != kinds[f.name]
    ]
    mine, theirs = canonical(frame.columns, rows), canonical(names, expected)
    note = f"{len(mine)} rows, {took:.1f}s" + (f" TYPES {odd}" if odd else "")
    if mine == theirs:
        return not odd and len(mine) > 0, note
    differ = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return False, f"{note} against {len(theirs)}; {len(differ)} differ; {sorted(names)}\n   {differ[:1]}"


def main() -> None:
    from tidegrid.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = oracle_connection(sf_dir)
    failed = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as problem:  # report every query, then fail
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:700]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
