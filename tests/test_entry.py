"""Driver contract: entry() runs, every query has a callable, oracle keys are a subset, every core query
builds and runs, and all of it works without the optional folders."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E
from riskspark.plans import queries as Q

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CORE = sorted(name for name, fn in E.queries().items() if fn.__module__ == Q.__name__)


def test_entry_runs(spark):
    df = E.entry(spark)
    out = df.collect()
    assert len(out) >= 1
    assert {"model", "accuracy", "roc_auc", "pr_auc", "ks"} <= set(df.columns)


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("name", CORE)
def test_core_query_runs(spark, name):
    df = E.queries()[name](spark, E.SMOKE_DIR)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry_without_optional_folders(tmp_path):
    """A copy without riskspark/llm, with and without the pipeline's file."""
    shutil.copytree(os.path.join(ROOT, "riskspark"), tmp_path / "riskspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    ask = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in E.queries()))"
    for with_pipeline in (False, True):
        if with_pipeline:
            (tmp_path / "corpus_pipeline.py").write_text("from riskspark.llm import packing\n")
        said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        n, sql, optional = said.stdout.split()
        assert int(n) == len(CORE) and int(sql) >= 60 and optional == "False"
