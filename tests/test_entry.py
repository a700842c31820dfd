"""The entry file without the training-data subpackage: on copies of the repository from which it is gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "weekly_summary" in q and "weekly_summary" in o and set(o) <= set(q)
assert "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in q)
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_queries_without_the_subpackage(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md",
                                                              *["corpus_pipeline.py"] * pipeline_too))
    assert not (copy / "tillroll" / "llm").exists()
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=copy, timeout=300, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
