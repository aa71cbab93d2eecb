"""What a session needs: a package that workers can import, and a folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache, wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ensure_importable(spark: SparkSession) -> None:
    """Put the folder of this package on the workers' PYTHONPATH, whatever folder the driver was started in.

    Executors on machines without that folder need the package by --py-files.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def importable(f: Callable) -> Callable:
    """f, whose first argument is the session, after ensure_importable."""

    @wraps(f)
    def run(spark: SparkSession, *args):
        ensure_importable(spark)
        return f(spark, *args)

    return run


@cache
def _own_dir() -> str:
    """A folder of this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="sentrylake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session may do without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, or earlier by remove()."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = hadoop(spark, folder)
    files.mkdirs(at)  # only what exists can be marked
    files.deleteOnExit(at)
    return f"{folder}/data"
