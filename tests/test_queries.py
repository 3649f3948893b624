"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from cuesheaf.plans import registry

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, same):
    same(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(name, spark):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
