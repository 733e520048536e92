"""The driver imports __spark_entry__.py from elsewhere with its own plain
session: UDFs and the data source must still find the package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry", "{ROOT}/__spark_entry__.py")
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
assert E.entry(spark).count() == 200
q = E.queries()
for name in ["mask_literal_secrets", "inventory_scan", "stream_retry"]:
    assert q[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("FOREIGN-OK")
"""


def test_queries_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="snapplan-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "FOREIGN-OK" in out.stdout, out.stderr[-2000:]
