"""Every query in a fresh process whose working directory is not the
repository: executors have no copy of the package on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
spec = importlib.util.spec_from_file_location("se", "{REPO}/__spark_entry__.py")
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
q = m.queries()
names = [n for n in q if n.startswith("op") or n == "pipeline"]
for n in names:
    q[n](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("ALL-OK", len(names))
"""


def test_queries_from_foreign_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "ALL-OK 14" in r.stdout, r.stderr[-3000:]
