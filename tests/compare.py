"""Runs registered queries against their SQL counterparts in DuckDB and compares all values.

    python tests/compare.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}"
    a, b = _sorted(got, df.columns), _sorted(want, columns)
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}; only here {[x for x in a if x not in set(b)][:2]}; only there {[x for x in b if x not in set(a)][:2]}"
    if not a:
        return "no rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> None:
    from streamatlas.plans.all_queries import ORACLES, QUERIES
    from streamatlas.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name, query in QUERIES.items():
        if args[1:] and not any(part in name for part in args[1:]):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, query, ORACLES[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).collect() else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += problem is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
