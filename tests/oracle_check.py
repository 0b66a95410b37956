"""Compare registered queries with their SQL on the same tables.

    python tests/oracle_check.py [sf_dir] [name ...]
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


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if v is None:
        return "\0null"
    return repr(v) if not isinstance(v, str) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def compare(name, fn, sql, spark, con, sf_dir) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    notes = []
    for f in df.schema.fields:
        t = SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if t != types[f.name]:
            notes.append(f"{f.name}: {t} vs {types[f.name]}")
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        return False, f"rows {len(a)} vs {len(b)}; cols {sorted(got_cols)}\n   spark only {only_a}\n   sql only {only_b}"
    return not notes, f"{len(a)} rows {'types ' + str(notes) if notes else ''}"


def main() -> int:
    from cutline.session import build_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false"
    )
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            if name in sqls:
                ok, msg = compare(name, fn, sqls[name], spark, con, sf_dir)
            else:
                ok, msg = True, f"{len(fn(spark, sf_dir).collect())} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
