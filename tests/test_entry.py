"""The registry works with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"


@pytest.mark.parametrize("gone", [("touchgrid/llm", "tests/llm"), ("touchgrid/llm", "tests/llm", "corpus_pipeline.py"), ()])
def test_registry_without_the_training_data_part(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    n, pipeline, ops = done.stdout.split()
    assert int(n) > 50
    whole = (copy / "touchgrid/llm").exists()
    assert (pipeline, ops) == (str(whole and (copy / "corpus_pipeline.py").exists()), str(whole))


def test_other_import_errors_are_not_swallowed(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    if not (copy / "touchgrid/llm").exists():
        pytest.skip("the training-data part was removed")
    (copy / "touchgrid/llm/queries.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
