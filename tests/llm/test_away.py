"""Operators on executors that have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_scores_where_only_the_driver_has_the_package(tmp_path, sf):
    code = f"""
import sys
sys.path.append({ROOT!r})
from __spark_entry__ import queries
from broadsheet.session import build_session
spark = build_session("away", "2", spark__driver__memory="2g")
rows = queries()["op8_toxicity"](spark, {sf!r})
assert rows.count() == spark.read.parquet({sf!r} + "/documents.parquet").count()
assert rows.filter("score between 0 and 1").count() == rows.count()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
