"""Run registered queries and their SQL over the same tables and compare them row by row.

    python tests/oracle_check.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(_cell(v) for v in value)
    return value


def _order(row):
    return tuple((v is not None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def compare(spark, con, sf_dir: str, build, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    df = build(spark, sf_dir)
    cols = sorted(df.columns)
    left = sorted((tuple(_cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=_order)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    right = sorted((tuple(_cell(r[i]) for i in at) for r in cur.fetchall()), key=_order)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    if not left:
        return "no rows"
    for a, b in zip(left, right):
        if [type(v) for v in a] != [type(v) for v in b] and any(
            x is not None and y is not None and type(x) is not type(y) for x, y in zip(a, b)
        ):
            return f"types: {dict(zip(cols, a))} against {dict(zip(cols, b))}"
        if a != b:
            return f"values: {[(c, x, y) for c, x, y in zip(cols, a, b) if x != y]} in {dict(zip(cols, a))}"
    return ""


def main() -> int:
    from tests.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                trouble = compare(spark, con, sf_dir, build, oracles[name])
            else:
                trouble = "" if build(spark, sf_dir).limit(5).collect() else "no rows"
        except Exception as error:
            trouble = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(trouble)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if trouble else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {trouble}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
