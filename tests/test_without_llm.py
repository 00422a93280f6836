"""The library without its part for training data, with and without the pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LOOK = "import __spark_entry__ as e; q = set(e.queries()); print(len(q), any(n.startswith('op1') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("left_over", [True, False])
def test_import_without_the_folder(tmp_path, left_over):
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *(() if left_over else ("corpus_pipeline.py",)))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skipped)
    assert not (tmp_path / "repo/corpusdesk/llm").exists() and (tmp_path / "repo/corpus_pipeline.py").exists() is (left_over and (ROOT / "corpus_pipeline.py").exists())
    run = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    n, any_llm = run.stdout.split()
    assert int(n) > 100 and any_llm == "False"
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
