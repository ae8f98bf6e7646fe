"""Executors that do not have the package can run what is broadcast to them."""

import os
import subprocess
import sys

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from locuslake.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
for name in ("p1_found", "p2_found"):
    assert queries.Q[name](spark, sys.argv[3]).count() > 0
print("done")
"""


def test_workers_without_the_package(tmp_path, sf):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", RUN, repo, str(tmp_path / "shared"), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert r.stdout.strip().endswith("done"), r.stderr[-3000:]
