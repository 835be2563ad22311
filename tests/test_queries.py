"""Every registered query of the engine against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from statloom import api_queries, queries  # noqa: F401  (api_queries registers with queries)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    found = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert plain(df.select(*(f"`{c}`" for c in found.columns)).collect()) == plain(found.fetchall())


def test_entry_without_corpus_operators():
    """The entry module imports with the corpus subpackage absent."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'q01_select' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0
