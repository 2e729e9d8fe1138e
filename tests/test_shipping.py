"""The package reaches Python workers that do not have it on their path."""

import os
import subprocess
import sys
import zipfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.addPyFile(sys.argv[1])
from flowloom.sources.sequences import read_sequences
print("ROWS", read_sequences(spark, sys.argv[3]).count())
"""


def test_package_is_shipped_as_an_archive(tmp_path):
    archive = tmp_path / "flowloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "flowloom")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    data = tmp_path / "data"
    data.mkdir()
    (data / "x.data").write_text("1 2 3 4\n5 6 7 8\n")
    (data / "x.label").write_text("01\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", JOB, str(archive), str(tmp_path / "shared"), str(data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS 2" in done.stdout, done.stderr[-2000:]
