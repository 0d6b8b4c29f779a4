"""Every registered query of the engine against DuckDB on the same tables, or for its shape where SQL can't express it."""

import pytest

from quillspark.plans import catalog, days, details, intake, library, pages  # noqa: F401  the others add their queries to the catalog

from .parity import connection, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == duck_rows(con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
