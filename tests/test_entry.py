"""The driver's contract, with the llm folders and without them."""

import shutil
from pathlib import Path

import __spark_entry__ as entry

from .conftest import run_python

ROOT = Path(__file__).parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["vec_id", "score", "rank"]


def _copy(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    return tmp_path / "repo"


def test_import_without_the_llm_folders(tmp_path):
    repo = _copy(tmp_path)
    for gone in ("docweft/llm", "tests/llm"):
        shutil.rmtree(repo / gone, ignore_errors=True)
    (repo / "corpus_pipeline.py").unlink(missing_ok=True)
    done = run_python("import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)", str(repo))
    assert done.returncode == 0, done.stderr


def test_other_import_errors_are_not_swallowed(tmp_path):
    repo = _copy(tmp_path)
    if (repo / "corpus_pipeline.py").exists():
        (repo / "corpus_pipeline.py").write_text("import no_such_module\n")
        assert run_python("import __spark_entry__", str(repo)).returncode
