import pytest

from rulelens.plans import compare_queries, ingest_queries, normalize_queries, search_queries, store_queries  # noqa: F401
from rulelens.plans.registry import ORACLES, QUERIES
from tests import oracle
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    oracle.same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
