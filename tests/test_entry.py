"""The driver's module works without the subpackage that may be taken away."""

import os
import shutil
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_training_data_operators():
    bare = tempfile.mkdtemp(prefix="run-")
    shutil.copytree(f"{ROOT}/faultline", f"{bare}/faultline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", bare)
    code = (
        "import __spark_entry__ as e; names = set(e.queries()); assert 'dashboard_summary' in names; "
        "assert not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in names); "
        "assert set(e.oracle_sql()) <= names")
    subprocess.run([sys.executable, "-c", code], cwd=bare, env={**os.environ, "PYTHONPATH": bare}, check=True)
