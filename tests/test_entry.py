"""The driver contract holds with the corpus operators, without their folder, and without their folder and the pipeline."""

import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

CORE = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(*sorted(names))"


def names(folder):
    run = subprocess.run([sys.executable, "-c", CORE], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_corpus_operators(tmp_path, left_out):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda _, names: [n for n in names if n in (*left_out, ".git", "__pycache__")])
    found = names(copy)
    assert "q04_group_concat" in found
    assert not any(n.startswith("op") or n == "pipeline" for n in found)


def test_with_what_is_there():
    found = names(ROOT)
    assert "q04_group_concat" in found
    there = (ROOT / "tarnlake" / "llm").exists()
    assert any(n.startswith("op1_") for n in found) == there
    assert ("pipeline" in found) == (there and (ROOT / "corpus_pipeline.py").exists())
