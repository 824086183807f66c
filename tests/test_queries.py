"""Every query against its SQL on the smallest tables."""

import __spark_entry__ as contract
import pytest
from checks.catalog import ORACLES, QUERIES
from checks.compare import connect, difference
from conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, name, SF_DIR) == ""


def test_contract(spark):
    assert contract.entry(spark).columns == ["digest_id", "chunk_no", "chunk"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(ORACLES) <= set(QUERIES)
