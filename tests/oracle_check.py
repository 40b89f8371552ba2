"""Run registered queries next to their SQL statement and compare the rows.

    python tests/oracle_check.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def sql_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def _plain(v):
    if v is None:
        return ("0null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("num", round(v, 6) + 0.0)
    if isinstance(v, int):
        return ("num", float(v))
    if hasattr(v, "isoformat"):
        return ("time", v.isoformat())
    if isinstance(v, (bytes, bytearray)):
        return ("bytes", bytes(v))
    if isinstance(v, (list, tuple)):
        return ("list", tuple(_plain(x) for x in v))
    if type(v).__name__ == "Decimal":
        return ("num", float(v))
    return ("str", str(v))


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    return cols, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, fn, sql: str | None):
    df = fn(spark, sf_dir)
    names = df.columns
    got = normal(names, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got[1]), "no sql"
    want = normal(*sql_rows(sf_dir, sql))
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return len(got[1]), f"rows {len(got[1])} vs {len(want[1])}; e.g. {list(set(got[1]) ^ set(want[1]))[:2]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return len(got[1]), f"{len(bad)} rows differ, e.g. {bad[0]}"
    return len(got[1]), "ok"


def main(argv):
    import __spark_entry__ as entry
    from maskloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, parts = argv[0], argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in queries:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            n, verdict = compare(spark, sf_dir, queries[name], oracles.get(name))
        except Exception as e:  # report and go on with the next query
            n, verdict = -1, f"{type(e).__name__}: {str(e)[:700]}"
        if verdict not in ("ok", "no sql"):
            failed.append(name)
        print(f"{name:40s} {n:8d} rows {time.time() - start:6.1f}s  {verdict}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
