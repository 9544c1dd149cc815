"""Every registered query against its SQL, or for its shape where SQL cannot say."""

import pytest

import __spark_entry__ as entry
from compare import check

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# The smallest tables have too few districts for a second page.
EMPTY_WHEN_SMALL = {"grade_page"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 35


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    problem, rows, _ = check(spark, name, QUERIES[name], ORACLES.get(name), SF, tolerance=1e-5)
    spark.catalog.clearCache()
    assert problem is None
    assert rows > 0 or name in EMPTY_WHEN_SMALL
