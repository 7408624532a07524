"""Compare every query with its SQL on one data folder: ``python tests/oracle.py [FOLDER] [NAME ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            path = os.path.join(folder, f, "*.parquet") if os.path.isdir(os.path.join(folder, f)) else os.path.join(folder, f)
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    return str(v)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """None if rows and columns agree, else what differs."""
    got = query(spark, folder)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(columns)}"
    order = sorted(columns)
    a = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    at = [columns.index(c) for c in order]
    b = sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    if a != b:
        extra, lost = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"{len(a)} rows against {len(b)}; only here {extra[:2]}; only there {lost[:2]}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, bad = views(folder), entry.queries(), 0
    sqls = entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    for name in names:
        t = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, name, queries[name], sqls[name], folder)
            else:
                why = f"(no SQL) {queries[name](spark, folder).count()} rows"
        except Exception as error:  # noqa: BLE001
            why = f"ERROR {str(error)[:600]}"
        bad += bool(why) and not why.startswith("(no SQL)")
        print(f"{name}: {why or 'ok'} [{time.time() - t:.1f} s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main()))
