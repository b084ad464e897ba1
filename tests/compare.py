"""Run registered queries next to their SQL and compare columns, rows and values."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{root}/{t}.parquet')")
    return con


def plain(v):
    import datetime
    import decimal

    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if v != 0 else 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, entry, root) -> tuple[bool, str]:
    began = time.time()
    df = entry.run(spark, root)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if entry.sql is None:
        return True, f"{len(got)} rows (no SQL), spark {took:.1f}s"
    cur = con.execute(entry.sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}\n   spark {got[:2]}\n   sql   {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        text = "\n".join(f"   spark {a!r:.600}\n   sql   {b!r:.600}" for a, b in bad[:2])
        return False, f"{len(bad)} of {len(got)} rows differ\n{text}"
    return True, f"{len(got)} rows, spark {took:.1f}s"


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from lorespan.plans import load
    from lorespan.session import local_session

    root = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = local_session(), duck(root)
    entries = {k: v for k, v in load().items() if not wanted or any(k.startswith(w) for w in wanted)}
    failed = []
    for k, e in entries.items():
        t = time.time()
        try:
            ok, note = compare(spark, con, k, e, root)
        except Exception as exc:  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {k} {time.time() - t:.2f}s {note}", flush=True)
        if not ok:
            failed.append(k)
    print(f"{len(entries) - len(failed)} of {len(entries)} agree; failed: {failed}")
