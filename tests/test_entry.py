"""The driver's contract: queries and SQL by name, with and without the optional subpackage."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tyche.plans.oracle import ORACLE
from tyche.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found, wanted = entry.queries()[name](spark, SMALL), db.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    assert sorted(map(tuple, found.select(columns).collect()), key=key) == sorted(wanted.select(*columns).fetchall(), key=key)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["vertex", "probability"]


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((root / name).read_text())
    for source in (root / "tyche").rglob("*.py"):
        if "llm" not in source.relative_to(root).parts:
            (to := tmp_path / source.relative_to(root)).parent.mkdir(parents=True, exist_ok=True)
            to.write_text(source.read_text())
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    queries, sql = map(int, run("import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))").stdout.split())
    assert queries == len(QUERIES) and sql == len(ORACLE)
    # What is there but does not import is an error, not an absence.
    (tmp_path / "tyche" / "llm").mkdir()
    (tmp_path / "tyche" / "llm" / "queries.py").write_text("import there_is_no_such_module\n")
    assert "there_is_no_such_module" in run("import __spark_entry__").stderr
