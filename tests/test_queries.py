"""Every registered query of the document engine against its DuckDB SQL on the smallest tables."""

import pytest

from pagemill.plans import registry

from .conftest import SF


def _rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype.kind == "f":
            frame[name] = frame[name].round(6)
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    found, expected = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    for column in found.columns:
        if found[column].dtype.kind == "f":
            expected[column] = expected[column].astype(float)
    assert _rows(found) == _rows(expected)


def test_queries_without_sql_run(spark):
    for name in registry.queries().keys() - registry.oracle_sql().keys():
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
