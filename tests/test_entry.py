import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from framelake.plans import suite

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: None if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = suite.QUERIES[name](spark, DATA)
    want = duck.execute(suite.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert norm(df.columns, df.collect()) == norm(names, want.fetchall())


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(suite.QUERIES) <= set(q) and set(s) <= set(q) and entry.entry(spark).count() > 0
    assert importlib.import_module("framelake").__doc__


@pytest.mark.parametrize("pipeline", [False, True])
def test_works_without_the_training_data_operators(tmp_path, pipeline):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "framelake", tmp_path / "framelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from framelake.llm import quality\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120)
    assert out.stdout.split() == [str(len(suite.QUERIES)), str(len(suite.SQL))]
