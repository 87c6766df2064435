"""``__spark_entry__`` imports when PySpark is loaded from ``pyspark.zip`` (as
under ``spark-submit``) and touches neither a jar nor a session."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_imports_from_pyspark_zip():
    lib = Path(pyspark.__file__).parent / "python" / "lib"
    zips = sorted(lib.glob("*.zip"))
    if not zips:
        pytest.skip("this PySpark ships no zip")
    code = ("import pyspark; assert '.zip' in pyspark.__file__, pyspark.__file__\n"
            "import __spark_entry__ as e\n"
            "from pyspark import SparkContext\n"
            "assert SparkContext._active_spark_context is None\n"
            "assert len(e.queries()) >= 64 and len(e.oracle_sql()) >= 43\n")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*map(str, zips), str(ROOT)])}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
