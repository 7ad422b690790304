"""The driver entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def loaded(folder):
    said = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return tuple(map(int, said.stdout.split()))


def test_loads_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "stowage"):
        if os.path.isdir(f"{HERE}/{name}"):
            shutil.copytree(f"{HERE}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(f"{HERE}/{name}"):
            shutil.copy(f"{HERE}/{name}", tmp_path / name)
    n, sql, extra = loaded(tmp_path)
    assert n >= 60 and n == sql and extra == 0
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert loaded(tmp_path) == (n, sql, 0)
