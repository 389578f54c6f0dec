"""The library without its training-text part: the entry module must import and list the rest."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from pollwright.catalog import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("pollwright/llm", "corpus_pipeline.py"), ("pollwright/llm",), ("corpus_pipeline.py",)])
def test_entry_imports_without(tmp_path, gone):
    skipped = {os.path.join(ROOT, g) for g in gone}

    def ignore(folder, names):
        return [n for n in names if os.path.join(folder, n) in skipped or n in (".git", "__pycache__", "spark-warehouse")]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names = set(done.stdout.split())
    assert set(registry.QUERIES) <= names and ("pipeline" in names) is False
    assert any(n.startswith("op1_") for n in names) is ("pollwright/llm" not in gone)
