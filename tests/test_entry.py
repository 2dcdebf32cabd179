"""The entry module works without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_training_data(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "tests", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_without_what_training_data_needs(tmp_path):
    """A missing tokenizer package costs the training-data queries only, and is told."""
    (tmp_path / "sentencepiece.py").write_text("raise ModuleNotFoundError('no sentencepiece', name='sentencepiece')")
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q)"
    run = subprocess.run([sys.executable, "-W", "always", "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, check=True, capture_output=True, text=True)
    assert "left out: no xxhash" in run.stderr or not (ROOT / "pagewright" / "llm").exists(), run.stderr


def test_nothing_imports_training_data():
    for p in (ROOT / "pagewright").rglob("*.py"):
        if "llm" not in p.parts:
            assert "pagewright.llm" not in p.read_text(), p
