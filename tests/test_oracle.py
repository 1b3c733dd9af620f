"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

from faultline.plans import registry


@pytest.fixture(scope="module")
def connection(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, sf, connection, name):
    ok, message = compare(spark, connection, sf, registry.QUERIES[name], registry.ORACLES.get(name))
    assert ok, message


def test_entry_returns_incidents(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
