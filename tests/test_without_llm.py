"""The rest of the library imports and answers without the training-data subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

ASK = """
import __spark_entry__ as e
names = set(e.queries())
assert "recency_weight" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert set(e.oracle_sql()) <= names
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_import(tmp_path, pipeline):
    to = tmp_path / "tree"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not (to / "tidewell/llm").exists() and not (to / "tests/llm").exists() and (to / "corpus_pipeline.py").exists() == pipeline
    run = subprocess.run([sys.executable, "-c", ASK], cwd=to, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
