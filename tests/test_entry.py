"""The entry module with and without the llm subpackage and the corpus pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as E; print(*sorted(E.queries()), '/', *sorted(E.oracle_sql()))"


@pytest.mark.parametrize("gone", [("jobframe/llm",), ("jobframe/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_other_queries_register_without_llm(tmp_path, gone):
    from jobframe.plans import catalog

    catalog.load_all()
    left_out = [os.path.join(ROOT, g) for g in gone]
    shutil.copytree(os.path.join(ROOT, "jobframe"), tmp_path / "jobframe",
                    ignore=lambda d, names: [n for n in names if os.path.join(d, n) in left_out or n == "__pycache__"])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
    names, sql = (part.split() for part in run.stdout.split(" / "))
    assert set(catalog.QUERIES) <= set(names) and set(catalog.ORACLE) <= set(sql)
    if "jobframe/llm" in gone:
        assert set(names) == set(catalog.QUERIES) and set(sql) == set(catalog.ORACLE)
    assert "pipeline" not in names
