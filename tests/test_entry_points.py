"""The entry points without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PRINT = "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"


def test_import_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy)
    for name in ("checks", "perindex"):
        shutil.copytree(ROOT / name, copy / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = subprocess.run([sys.executable, "-c", PRINT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    count, names = run.stdout.split(" ", 1)
    assert int(count) > 70
    assert names.strip() == "[]"


def test_test_modules_have_different_names():
    names = [p.name for p in (ROOT / "tests").rglob("test_*.py")]
    assert len(names) == len(set(names))
