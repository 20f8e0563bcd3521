"""The engine must work when the optional subpackage and the pipeline are not there."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT / "codehealth", tmp_path / "codehealth", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "codehealth").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "codehealth.llm" not in path.read_text(), path
