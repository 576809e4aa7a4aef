"""Every registered query over the key/value tables gives what its SQL gives."""

import duckdb
import pytest

from kvloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda x: round(float(x), 6) if isinstance(x, float) else x if isinstance(x, (int, str, type(None))) else str(x)
    return sorted((tuple(shown(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_sorted_forms_are_sorted(spark):
    got = [r["key"] for r in catalog.queries()["join_unsorted_lsj_sorted_output"](spark, SF).collect()]
    assert got == sorted(got)


def test_entry_imports_without_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "kvloom", tmp_path / "kvloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'join_lsj' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
