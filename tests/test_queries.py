"""Every registered query of the engine against its SQL."""

import pytest

from logweave.plans import catalog

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
