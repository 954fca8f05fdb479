"""The entry works without the training-data operators, whichever part of them is missing."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", [["kindred/llm", "tests/llm"], ["kindred/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_parts(tmp_path, missing):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *(Path(x).name for x in missing)))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr
    n, pipeline, operators = said.stdout.split()
    assert int(n) >= 72 and pipeline == "False" and operators == str("kindred/llm" not in missing)
