"""The entry module on a tree without the corpus operators."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    tree = tmp_path / "tree"
    left_out = shutil.ignore_patterns("llm", "__pycache__", ".git", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tree, ignore=left_out)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tree, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    found, sql = (set(line.split()) for line in done.stdout.splitlines())
    assert {"panel_build", "rf_fit"} <= found and sql <= found
    assert not [name for name in found if name.startswith("op") and name[2].isdigit()] and "pipeline" not in found
