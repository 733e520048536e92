"""Run every registered query the way an outside driver would: a plain
default SparkSession, __spark_entry__.py loaded by path, results compared
with the DuckDB oracles.

    python tools/driver_sim.py [/root/testdata/sf0.01]
"""

import importlib.util
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tools.oracle_check import digest, type_diff  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    E = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(E)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad, t0 = 0, time.time()
    for n, fn in sorted(E.queries().items()):
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            res = con.execute(E.oracle_sql()[n])
            drows, dcols = res.fetchall(), [d[0] for d in res.description]
            ok = sorted(df.columns) == sorted(dcols) and digest(df.columns, rows)[0] == digest(dcols, drows)[0]
            td = type_diff(df, res)
            if not ok or td:
                bad += 1
                print("MISMATCH", n, td, flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print("ERROR", n, type(e).__name__, str(e)[:300], flush=True)
    print("DONE bad=", bad, "secs=", round(time.time() - t0), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
