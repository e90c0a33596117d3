"""The library and its contract without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'run_verdicts' in q; print(sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_without_the_subpackage(tmp_path, pipeline_too):
    shutil.copytree(ROOT / "evalspark", tmp_path / "evalspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if not pipeline_too and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and out.stdout.strip() == "0", out.stderr
