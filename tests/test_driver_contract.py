"""The driver's way in: a plain session, started from another directory,
imports __spark_entry__ by path and runs entry() and a query with Arrow UDFs
(the package reaches the Python workers through addPyFile)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
df = E.entry(spark)
n = df.count()
m = E.queries()["rouge_l"](spark, "/root/testdata/sf0.001").count()
print("RESULT", n, sorted(df.columns), m)
spark.stop()
"""


def test_entry_from_another_directory():
    d = tempfile.mkdtemp(prefix="ld-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env, capture_output=True, text=True,
                       timeout=600)
    line = [x for x in r.stdout.splitlines() if x.startswith("RESULT")]
    assert line, r.stderr[-3000:]
    parts = line[0].split(" ", 2)
    assert int(parts[1]) > 0
    assert "score" in parts[2]
