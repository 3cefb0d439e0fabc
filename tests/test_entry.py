"""The driver contract, run the way the driver runs it: a fresh process
whose working directory is not the repository (Python UDF code must reach
the executors without the package on their path)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
spec = importlib.util.spec_from_file_location("se", "{REPO}/__spark_entry__.py")
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
df = m.entry(spark)
assert df.columns == ["rebalance_date", "ticker", "weight"], df.columns
n = df.count()
assert n > 0
q, o = m.queries(), m.oracle_sql()
assert set(o) <= set(q)
assert q["classify_udf"](spark, "/root/testdata/sf0.001").count() == 200
print("ENTRY-OK", n, len(q), len(o))
"""


def test_entry_from_foreign_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                       timeout=900)
    assert "ENTRY-OK" in r.stdout, r.stderr[-3000:]
