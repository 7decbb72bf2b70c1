"""Executors of their own, outside the repository's folder, get the package from the driver."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print("rows", entry.queries()["custom_function"](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_get_the_code(tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "run.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path / "shared")], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=240)
    assert "rows 6000" in out.stdout, out.stderr[-3000:]
