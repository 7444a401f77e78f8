"""Python workers find the package whatever folder the session starts in."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import os, sys
sys.path.append({repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
for name in ("html_to_text", "knn_join"):
    print(name, len(entry.queries()[name](spark, {data!r}).collect()))
"""


def test_from_an_empty_folder(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, data=sf_dir)],
                          cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(int(line.split()[1]) > 0 for line in done.stdout.splitlines() if line.startswith(("html", "knn")))
