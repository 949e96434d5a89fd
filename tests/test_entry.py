"""The driver's contract, with and without the optional parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from lakeplan import plans

ROOT = Path(__file__).parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).columns == ["n_name", "revenue"]


def test_the_engine_stands_alone(tmp_path):
    """Without the training-data operators the rest imports and registers its own queries."""
    shutil.copytree(ROOT / "lakeplan", tmp_path / "lakeplan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op1_') or n == 'pipeline' for n in q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == [str(len(plans.QUERIES)), "False"], run.stderr


def test_nothing_else_imports_the_operators():
    for p in (ROOT / "lakeplan").rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "lakeplan.llm" not in text and ".llm" not in text, p
