"""Every query with SQL against DuckDB, and the entry without the llm parts."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sentrylake.plans import queries

ROOT, SMALL = Path(__file__).resolve().parents[1], Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(SMALL))
    result = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("gone", [["sentrylake/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], ["sentrylake/llm"]])
def test_entry_without_the_llm_parts(tmp_path, gone):
    for p in ("sentrylake", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / p
        if src.is_dir():
            shutil.copytree(src, tmp_path / p, ignore=shutil.ignore_patterns("__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / p)
    for p in gone:
        if (tmp_path / p).is_dir():
            shutil.rmtree(tmp_path / p)
        else:
            (tmp_path / p).unlink(missing_ok=True)
    there = bool((ROOT / "sentrylake/llm").is_dir()) and "sentrylake/llm" not in gone
    code = (
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        f"assert any(n.startswith('op') for n in q) == {there} and 'pipeline' not in q\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert e.entry(spark).count() > 0 and q['space_saving_evicting'](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=180, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
