"""The entry module, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).columns == ["hash", "raw", "asks", "days", "kind", "message_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    for name in ("quarry", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "quarry" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[-1] == "False" and int(said.stdout.split()[0]) > 80, said.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quarry.llm" not in path.read_text()
