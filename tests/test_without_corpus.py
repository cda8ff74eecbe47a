"""The queries of the package stand without the training-data subpackage and without the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__  # noqa: F401 - registers the queries
from foliograph.plans import bind

REPO = Path(__file__).resolve().parent.parent
LOOK = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n in q for n in e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in q))"


@pytest.mark.parametrize("gone", [["foliograph/llm", "tests/llm", "corpus_pipeline.py"], ["foliograph/llm", "tests/llm"]])
def test_queries_load(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        whole = copy / name
        shutil.rmtree(whole) if whole.is_dir() else whole.unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", LOOK], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(bind.QUERIES)), str(len(bind.SQL)), "False"], out.stderr[-1000:]
    seen = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert seen.returncode == 0, seen.stdout[-1000:]
