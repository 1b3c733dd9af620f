"""Run queries in Spark and their oracle SQL in DuckDB, and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return float(value)
    return value


def normalised(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def compare(spark, con, sf_dir: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, sf_dir)
    rows = df.collect()
    spark_seconds = time.time() - start
    if sql is None:
        return len(rows) > 0, f"rows={len(rows)} spark={spark_seconds:.1f}s (rows only)"
    start = time.time()
    result = con.execute(sql)
    want = normalised([d[0] for d in result.description], result.fetchall())
    note = f"rows={len(rows)} spark={spark_seconds:.1f}s duckdb={time.time() - start:.1f}s"
    got = normalised(df.columns, rows)
    if got[0] != want[0]:
        return False, f"{note} columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return True, note
    differing = [(g, w) for g, w in zip(got[1], want[1], strict=False) if g != w]
    return False, f"{note} oracle rows={len(want[1])} differing={len(differing)} first={differing[:1]}"


if __name__ == "__main__":
    from faultline.plans import registry
    from faultline.session import local_session

    directory = sys.argv[1]
    names = sys.argv[2:] or list(registry.QUERIES)
    session = local_session(8)
    connection = duck(directory)
    for name in names:
        try:
            ok, message = compare(session, connection, directory, registry.QUERIES[name], registry.ORACLES.get(name))
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("OK  " if ok else "FAIL", name, message, flush=True)
