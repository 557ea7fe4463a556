"""Compare queries with their SQL twins: names, types, rows.

    python tests/compare.py [folder of tables] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both results agree, else what differs."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    types = {d[0]: str(d[1]) for d in want.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]}
    if odd:
        return f"types {odd}"
    expected, got = _rows(names, want.fetchall()), _rows(df.columns, [tuple(r) for r in df.collect()])
    if expected != got:
        extra, missing = list((got - expected).items())[:2], list((expected - got).items())[:2]
        return f"rows {sum(got.values())} vs {sum(expected.values())}; only here {extra}; only in SQL {missing}"
    return None


def main() -> int:
    from conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con, oracles, bad = make_session(), connect(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            problem = difference(df, con, oracles[name]) if name in oracles else None
            rows = "" if name in oracles else f"{df.count()} rows, no SQL"
        except Exception as error:  # report every query, then fail
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {rows}{(problem or '')[:1500]}", flush=True)
    print(f"{bad} failures; without query: {sorted(set(oracles) - set(entry.queries()))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
