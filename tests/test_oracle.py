"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__
from compare import compare, oracle
from tunedata.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    status, count, _, detail = compare(spark, con, name, QUERIES[name], sf_dir)
    assert status.startswith(("ok", "rows-only")), (status, detail)
    assert count > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
