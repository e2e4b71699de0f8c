"""The registry with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))"


def _said(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split(" ", 2)


def test_registry_without_the_optional_parts(tmp_path):
    from flowtide.plans.catalog import ORACLE, QUERIES

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert _said(copy) == [str(len(QUERIES)), str(len(ORACLE)), "[]\n"]


def test_registry_with_a_pipeline_but_no_operators(tmp_path):
    from flowtide.plans.catalog import QUERIES

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    assert _said(copy)[::2] == [str(len(QUERIES)), "[]\n"]
