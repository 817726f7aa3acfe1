"""Runs queries beside their SQL in DuckDB; usable as a script: compare.py SF_DIR NAME..."""

import glob
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if glob.glob(p + '/*.parquet') else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, con, query, sql, sf_dir):
    """(column names, rows) of either engine."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return (sorted(df.columns), rows(df.columns, got)), (sorted(names), rows(names, cur.fetchall()))


def session(n=8):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{n}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]:
        t = time.time()
        try:
            if name in oracles:
                a, b = both(spark, con, queries[name], oracles[name], sf)
                ok = a == b
                print("OK  " if ok else "DIFF", name, len(a[1]), round(time.time() - t, 1), flush=True)
                if not ok:
                    bad += 1
                    print("  cols", a[0], b[0], "rows", len(a[1]), len(b[1]))
                    sa, sb = set(a[1]), set(b[1])
                    print("  only spark", list(sa - sb)[:3], "\n  only duck", list(sb - sa)[:3])
            else:
                df = queries[name](spark, sf)
                r = df.collect()
                print("ROWS", name, len(r), round(time.time() - t, 1), str(r[:2])[:300], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print("FAIL", name, type(e).__name__, str(e)[:1500], flush=True)
    print("bad:", bad)
