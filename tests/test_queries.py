"""Every registered query with SQL against DuckDB; the others for rows and repeatability."""

import pytest
from compare import difference, duckdb_views

from gustwatch.catalogue import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
ROW_COUNTS = {
    "iforest_scores": 1000,
    "iforest_v2_scores": 1000,
    "gbt_event_prob": 1000,
    "horizon_scores": 1000,
    "sequence_recon_error": 1000,
    "recon_by_feature": 3,
    "feature_importance": 18,
}


@pytest.fixture(scope="module")
def connection():
    return duckdb_views(SF_DIR)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SF_DIR), connection, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    rows = QUERIES[name](spark, SF_DIR).count()
    assert rows == ROW_COUNTS.get(name, rows) and rows > 0
