"""Run a query and its SQL twin side by side and report differences."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int,)):
        return float(x) if abs(x) < 2**53 else x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (0.0 if x == 0 else x)
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    return x


def _family(type_name):
    """Coarse type family, so that a count never passes for a float."""
    name = str(type_name).lower()
    if "huge" in name or "decimal" in name:
        return f"avoid:{name}"
    if any(t in name for t in ("[]", "array", "struct", "map", "timestamp", "date")):
        return "nested" if "t" in name else name
    if any(t in name for t in ("int", "long", "short", "byte")):
        return "int"
    if any(t in name for t in ("double", "float")):
        return "float"
    if "bool" in name:
        return "bool"
    return "text"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, folder, run, sql):
    """(problem or None, rows, seconds in Spark, seconds in DuckDB)."""
    start = time.time()
    frame = run(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    mid = time.time()
    names = frame.columns
    if sql is None:
        return None, len(got), mid - start, 0.0
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    end = time.time()
    problem = None
    spark_types = {f.name: _family(f.dataType.simpleString()) for f in frame.schema}
    duck_types = {d[0]: _family(d[1]) for d in cursor.description}
    if spark_types != duck_types:
        pairs = {k: (spark_types.get(k), duck_types.get(k)) for k in {*spark_types, *duck_types}}
        problem = f"types differ: { {k: v for k, v in pairs.items() if v[0] != v[1]} }"
    elif any(v.startswith(("avoid", "nested")) for v in duck_types.values()):
        problem = f"unstable types {duck_types}"
    elif sorted(names) != sorted(want_names):
        problem = f"columns {sorted(names)} != {sorted(want_names)}"
    elif len(got) != len(want):
        problem = f"{len(got)} rows != {len(want)} rows"
    else:
        a, b = _rows(names, got), _rows(want_names, want)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problem = f"{len(bad)}/{len(a)} rows differ; cols {sorted(names)}; first: {bad[0][0]} != {bad[0][1]}"
    return problem, len(got), mid - start, end - mid


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from episodium.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, rows, a, b = compare(spark, con, folder, run, oracles.get(name))
        except Exception as error:  # report and go on
            problem, rows, a, b = f"ERROR {type(error).__name__}: {str(error)[:1500]}", -1, 0, 0
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        twin = "" if name in oracles else " (no oracle)"
        print(f"{mark} {name:32s} rows={rows:<8d} spark={a:6.2f}s duck={b:6.2f}s{twin} {problem or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
