"""Without the language-model subpackage everything else still works."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_without_the_llm_folders(tmp_path, gone):
    target = tmp_path / "repo"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=target, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    # The rest's tests are found without them, and those that are quick pass.
    tests = [sys.executable, "-m", "pytest", "-q", "tests"]
    found = subprocess.run([*tests, "--collect-only"], cwd=target, capture_output=True, text=True)
    assert found.returncode == 0 and "test_queries" in found.stdout, found.stdout[-2000:]
    some = subprocess.run([*tests, "-k", "bm25_corpus_stats or budgets or split_points"], cwd=target, capture_output=True, text=True)
    assert some.returncode == 0, some.stdout[-2000:]


def test_nothing_else_imports_the_subpackage():
    for p in ROOT.rglob("*.py"):
        inside = "llm" in p.parts or p.name in ("corpus_pipeline.py", "__spark_entry__.py", "test_guard.py")
        assert inside or "treeline.llm" not in p.read_text(encoding="utf-8"), p
