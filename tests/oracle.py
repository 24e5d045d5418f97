"""Runs registered queries beside their DuckDB form: ``python -m tests.oracle [--sf 0.01] [name part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(canonical(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(canonical(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if value.__class__.__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return seconds, len(got), "rows only"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(got_cols):
        return seconds, len(got), f"COLUMNS {sorted(got_cols)} != {sorted(cols)}"
    have = rows_of(got_cols, got)
    if have != want:
        diff = [(a, b) for a, b in zip(have, want) if a != b][:2]
        only = [r for r in have if r not in set(want)][:2] if len(have) < 20000 else []
        return seconds, len(got), f"VALUES {len(have)} vs {len(want)} rows; first {diff} only-spark {only}"
    wide = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if t in wide and wide[t] != types[c]]
    return seconds, len(got), "ok" + (f" (types {odd})" if odd else "")


def main(argv):
    from sondeo.session import local_session
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(p in name for p in argv):
            continue
        try:
            seconds, n, note = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            seconds, n, note = 0.0, -1, "ERROR " + str(exc)[:700]
        ok = note.startswith("ok") or note == "rows only"
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:44s} {seconds:6.2f}s {n:7d} {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main(sys.argv[1:])
