"""Run registered queries next to their check SQL and report mismatches.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return took, len(got), None
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return took, len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(zip(names, [str(t[1]) for t in cur.description]))
    a, b = rows_of(df.columns, got), rows_of(names, want)
    note = "" if sql_took < 10 else f" (sql {sql_took:.0f}s)"
    spark_types = dict(df.dtypes)
    odd = [c for c in names
           if (types[c].startswith("HUGEINT") or types[c].startswith("DECIMAL"))
           or (types[c] == "BIGINT") != (spark_types[c] == "bigint")
           or (types[c] == "DOUBLE") != (spark_types[c] == "double")]
    if odd:
        note += f" types: {[(c, spark_types[c], types[c]) for c in odd]}"
    if a == b:
        return took, len(got), note or ""
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return took, len(got), (f"rows {len(a)} vs {len(b)}\n   spark: {str(only_a)[:900]}"
                            f"\n   sql  : {str(only_b)[:900]}{'' if diff else ''}")


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from foliant.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    names = argv[1:] or list(qs)
    bad = 0
    for name in names:
        try:
            took, n, note = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            print(f"FAIL {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            bad += 1
            continue
        ok = note is None or note == "" or note.startswith(" ")
        bad += not ok
        label = "rows" if note is None else ("ok  " if ok else "DIFF")
        print(f"{label} {name}: {n} rows, {took:.2f}s {note or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
