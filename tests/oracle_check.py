"""Run registered queries next to their SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(sf: str):
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return ("nan",)
        return ("n", float(v))
    return ("s", str(v))


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in at) for r in rows)


def compare(spark, con, sf, name, fn, text):
    df = fn(spark, sf)
    got = df.collect()
    if text is None:
        return f"rows={len(got)} (no SQL)", len(got) > 0
    cur = con.execute(text)
    want_cols = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}", False
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", False
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}", False
    return f"rows={len(a)}", len(a) > 0


def main(argv):
    import __spark_entry__ as entry
    from tidewatch.session import local_session

    sf = argv[1]
    only = argv[2:]
    spark = local_session(8)
    con = connect(sf)
    sqls = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            note, ok = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            note, ok = "".join(traceback.format_exception_only(e)).strip()[:900], False
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv)
