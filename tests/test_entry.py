"""The driver contract, with and without the subpackage of text operators."""

from __future__ import annotations

import os
import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_text_subpackage():
    for path in (REPO / "corpuskiln").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"^\s*(?:from|import) corpuskiln\.llm", path.read_text(), re.M), path


def test_entry_works_without_the_text_subpackage(tmp_path):
    import shutil

    shutil.copytree(REPO / "corpuskiln", tmp_path / "corpuskiln", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q and e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_core_tests_pass_without_the_text_subpackage(tmp_path):
    """Every core test is still collected, and those of the functions pass, with both folders gone."""
    import shutil

    shutil.copytree(REPO / "corpuskiln", tmp_path / "corpuskiln", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(REPO / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(REPO / name, tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    for args in (["--collect-only", "-q", "tests"], ["-q", "tests/test_functions.py"]):
        done = subprocess.run([sys.executable, "-m", "pytest", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stdout[-3000:]


def test_a_broken_import_is_no_absence(tmp_path):
    import shutil

    shutil.copytree(REPO / "corpuskiln", tmp_path / "corpuskiln", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "corpuskiln" / "llm").mkdir(exist_ok=True)
    (tmp_path / "corpuskiln" / "llm" / "queries.py").write_text("import no_such_module\n")
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr
