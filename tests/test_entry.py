"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from spanloom.plans import queries  # noqa: F401
from spanloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    out = duck.execute(ORACLES[name])
    cols = [c[0] for c in out.description]
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in out.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_made_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_optional_part(tmp_path):
    """With the training-data folders gone the contract still imports, and names neither their queries nor the pipeline."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(repo, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(k.startswith('op1') for k in [*q, *o]); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0 and int(got.stdout) > 40, got.stderr[-2000:]
