"""The contract from a foreign folder: workers must not need this package installed."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ENTRY = Path(__file__).resolve().parent.parent / "__spark_entry__.py"

DRIVER = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
print("rows", len(contract.entry(spark).collect()))
for name in ("b09_failing_embedder", "b20_text_search", "b21_pack_and_unpack"):
    print(name, len(contract.queries()[name](spark, "/root/testdata/sf0.001").collect()))
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", DRIVER, str(ENTRY)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 150" in done.stdout and "b20_text_search 400" in done.stdout
