"""Every registered query against its SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests import compare

SF = "/root/testdata/sf0.01"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    ordered = name in compare.ORDERED
    got = compare.spark_rows(QUERIES[name](spark, SF), ordered)
    assert got[1], "the query must return rows"
    assert compare.difference(got, compare.oracle_rows(duck, ORACLE[name], ordered)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_import_needs_no_session():
    """Workers import the package, and nobody there has a session."""
    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e; e.queries(); e.oracle_sql();"
        "import tarn.plans.daily, tarn.streaming.landing, tarn.sources.jdbc"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/")
