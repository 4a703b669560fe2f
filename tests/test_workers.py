"""Grouped pandas functions must run when the job starts outside the repo
(the package is shipped to the Python workers)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
q = e.queries()
print("ROWS", q["calibrate_clips"](s, "/root/testdata/sf0.001").count())
s.stop()
"""


def test_pandas_functions_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="touchline-cwd-")
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=600,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1].split()[0]) > 0
