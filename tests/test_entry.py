import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from plotweave.plans.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]


def test_names_need_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(QUERIES) and int(out[1]) >= len(SQL)


@pytest.mark.parametrize("with_path", [False, True])
@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_works_without_the_corpus_package(tmp_path, left, with_path):
    """Without the llm folders, with or without the pipeline's file, the entry has all other queries."""
    for p in ROOT.iterdir():
        if p.name not in ("plotweave", "tests", ".git") and (p.name != "corpus_pipeline.py" or left == "pipeline"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "plotweave").mkdir()
    for p in (ROOT / "plotweave").iterdir():
        if p.name != "llm":
            (tmp_path / "plotweave" / p.name).symlink_to(p)
    if left == "empty folder":
        (tmp_path / "plotweave/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": str(tmp_path)} if with_path else {})
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert (int(out[0]), int(out[1])) == (len(QUERIES), len(SQL))


def test_nothing_else_imports_the_corpus_package():
    for p in (ROOT / "plotweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "plotweave.llm" not in p.read_text()


def test_sql_names_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 4 and all(r.total_s > 0 for r in rows)
