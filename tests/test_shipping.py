"""Tasks must not need the package on the executors."""

from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("c1_function_catalogue", "c9_located_any_depth", "c13_checked_code", "s1_archive_members", "s1_archive_scan", "s2_source_scan", "s3_tree_format"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_python_steps_run_from_another_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([line for line in done.stdout.splitlines() if line.startswith(("c", "s"))]) == 7
