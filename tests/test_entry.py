"""The library without its optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(len(entry.queries()), sum(name.startswith("op") and name[2].isdigit() for name in entry.queries()))
"""


def test_the_rest_imports_and_lists_its_queries_without_llm(tmp_path):
    leave_out = shutil.ignore_patterns("llm", ".*", "__pycache__")
    for folder in ("cohortlens", "tests"):
        shutil.copytree(HOME / folder, tmp_path / folder, ignore=leave_out)
    for file in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (HOME / file).exists():
            shutil.copy(HOME / file, tmp_path)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    registered, numbered = map(int, done.stdout.split())
    assert registered >= 98 and numbered == 0
