"""Executors need only the libraries: functions and models reach them by value."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from gridwell.llm.queries import queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name in ("op2_quality", "op4_toxicity", "op5_packing", "op8_language", "op10_bpe", "op11_jaccard", "op12_alignment", "op13_manifest"):
    print(name, queries()[name](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_do_not_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert len(out.stdout.split("\n")) == 9
