"""The driver's entry module in a process of its own."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    code = (
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "queries, twins = e.queries(), e.oracle_sql()\n"
        "assert len(queries) > 100 and set(twins) <= set(queries)\n"
        "assert SparkSession.getActiveSession() is None\n"
    )
    repo = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
