"""Workers find the package from any folder."""

import os
import subprocess
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_with_python_workers_run_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert e.queries()['space_saving_evicting'](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=180, env=env)


def test_scratch_folders_go_with_the_driver_and_must_be_shared(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from sentrylake import session\n"
        f"spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()\n"
        "path = session.scratch(spark, 'x')\n"
        "spark.range(5).write.parquet(path)\n"
        "assert spark.read.parquet(path).count() == 5\n"
        "class Far:\n"
        "    conf = type('C', (), {'get': staticmethod(lambda name, default=None: default)})\n"
        "    sparkContext = type('S', (), {'master': 'spark://far:7077'})\n"
        "try:\n"
        "    session.shared_dir(Far)\n"
        "    raise AssertionError\n"
        "except RuntimeError as e:\n"
        "    assert 'spark.checkpoint.dir' in str(e)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=180, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    ended = time.time()
    while list((tmp_path / "shared").glob("x-*")) and time.time() - ended < 30:
        time.sleep(0.5)
    assert not list((tmp_path / "shared").glob("x-*"))
