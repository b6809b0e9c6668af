"""Run registered queries against their SQL in DuckDB: python tests/compare.py [sf] [name ...]"""

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if isinstance(v, float) and v != v:
            return None
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime()
        if hasattr(v, "asDict"):
            return tuple(v)
        if isinstance(v, dict):
            return tuple(v.values())
        return v

    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    t0 = time.time()
    got = df.collect()
    secs = time.time() - t0
    if sql is None:
        return f"rows-only {len(got)} rows {secs:.2f}s", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    t1 = time.time()
    want = cur.fetchall()
    dsecs = time.time() - t1
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", False
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    st = dict(df.dtypes)
    bad = [(n, st[n], t) for n, t in zip(names, types) if kinds.get(st[n], st[n]) != t]
    a, b = normal(got, df.columns), normal(want, names)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"VALUES {len(a)} vs {len(b)} rows; first differences {str(diff)[:900]}", False
    note = f" TYPES {bad}" if bad else ""
    return f"{'ok' if a else 'EMPTY'} {len(a)} rows spark {secs:.2f}s duckdb {dsecs:.2f}s{note}", bool(a) and not bad


def main():
    import __spark_entry__ as entry
    from maskwork.catalog.base import Catalog
    from maskwork.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.maskwork.spread.partitions": "16", "spark.ui.showConsoleProgress": "false",
                                         "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    names = args[1:] or list(queries)
    modules = [n[1:] for n in names if n.startswith("@")]
    for m in modules:  # @traffic: every query of that catalog module
        part = Catalog()
        importlib.import_module(f"maskwork.catalog.{m}").register(part)
        names += list(part.queries)
    wanted = [q for q in queries if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    failed = []
    for name in wanted:
        t0 = time.time()
        try:
            msg, ok = compare(spark, con, folder, queries[name], oracles.get(name))
        except Exception as err:  # report and go on with the next query
            msg, ok = f"{type(err).__name__}: {str(err)[:1200]}", False
        print(f"{name}: {msg} (total {time.time() - t0:.1f}s)", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(wanted)} queries, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
