"""All operators on workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
repo, data = sys.argv[1:]
sys.path.insert(0, repo)  # of the driver only: workers start in another folder, without this path
from pyspark.sql import functions as F
from folioquery.session import build_session
from folioquery.llm.queries import QUERIES
import corpus_pipeline

settings = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"}
spark = build_session(master="local[8]", **settings)
spark.sparkContext.setLogLevel("ERROR")

def importable(batches):
    import importlib.util
    import pandas as pd
    for _ in batches:
        yield pd.DataFrame({"found": [importlib.util.find_spec("folioquery") is not None]})

assert not spark.range(1).mapInPandas(importable, "found boolean").first()[0]
for name, query in (QUERIES | {"pipeline": corpus_pipeline.run}).items():
    print(name, query(spark, data).count(), flush=True)
"""


def test_workers_need_no_copy_of_the_package(data, tmp_path):
    import os

    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", PROGRAM, repo, data], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    lines = [line for line in done.stdout.splitlines() if line.startswith(("op", "pipeline"))]
    assert len(lines) == 14 and all(int(line.split()[1]) > 0 for line in lines)
