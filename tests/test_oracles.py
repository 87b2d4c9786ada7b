"""Every registered query with SQL gives the rows of its SQL; those without give rows."""

import pytest

from cuelake.plans import registry
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, sf_dir, con):
    assert differences(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
