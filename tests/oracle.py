"""Compare registered queries with their SQL twins in DuckDB.

``python -m tests.oracle [sf] [name part ...]`` prints one line per query that differs.
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day)
    return v


def kind(t: str) -> str:
    t = t.lower()
    for spark, duck in (("bigint", "bigint"), ("int", "integer"), ("string", "varchar"), ("timestamp_ntz", "timestamp"),
                        ("double", "double"), ("boolean", "boolean"), ("date", "date"), ("float", "float"),
                        ("binary", "blob")):
        if t in (spark, duck):
            return spark
    return t.replace("decimal", "d").split("(")[0] if t.startswith("decimal") else "other"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {[g for g in got if g not in set(want)][:2]} vs {[w for w in want if w not in set(got)][:2]}", len(got)
    if got != want:
        def close(a, b):
            if isinstance(a, float) and isinstance(b, float):
                return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
            if isinstance(a, tuple) and isinstance(b, tuple):
                return len(a) == len(b) and all(map(close, a, b))
            return a == b
        bad = [(g, w) for g, w in zip(got, want) if not close(g, w)]
        if bad:
            return f"{len(bad)} values differ; got {str(bad[0][0])[:300]} want {str(bad[0][1])[:300]}", len(got)
    duck = {d[0]: kind(str(t)) for d, t in zip(con.execute(f"DESCRIBE {sql}").description, [])}
    types = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()} | duck
    odd = {c: (kind(t), types[c]) for c, t in df.dtypes if kind(t) != types[c]}
    return (f"types {odd}" if odd else None), len(got)


def main(argv):
    from brinelog.session import local_session
    import __spark_entry__ as entry
    sf = argv[0] if argv else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(p == n or (p.endswith("*") and n.startswith(p[:-1])) for p in argv[1:])]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                n, problem = len(df.collect()), None
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:500]}", -1
        took = time.time() - t0
        if problem:
            bad += 1
            print(f"BAD {name}: {problem}", flush=True)
        elif n == 0 or took > 5:
            print(f"note {name}: rows {n}, {took:.1f}s", flush=True)
    print(f"{len(names)} queries, {sum(n in oracles for n in names)} with SQL, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
