"""Every query that has SQL, against DuckDB on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import same, views

import __spark_entry__ as e
from tidejoin.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_as_sql(spark, con, name):
    ok, what = same(q.QUERIES[name](spark, SF), con, q.ORACLES[name])
    assert ok, what


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(q.QUERIES) <= set(e.queries())


def test_without_the_training_data_operators(tmp_path):
    repo = Path(e.__file__).parent
    shutil.copytree(repo, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'join_equi_hash' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", timeout=120).returncode == 0
