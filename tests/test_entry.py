import os
import shutil
import subprocess
import sys

import pytest

PIPELINE = "corpus_pipeline.py"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_optional_package(tmp_path, with_pipeline):
    names = ("recordloom", "__spark_entry__.py", *([PIPELINE] if with_pipeline and os.path.exists(f"{ROOT}/{PIPELINE}") else []))
    for name in names:
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "recordloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'near_dup_pairs' in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0


def test_nothing_outside_imports_the_optional_package():
    for folder, _, files in os.walk(f"{ROOT}/recordloom"):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for f in files:
                assert "recordloom.llm" not in open(f"{folder}/{f}").read(), f
