import pytest

from quire.plans import registry
from tests.compare import both, views


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    got, want = both(registry.QUERIES[name](spark, sf), con, registry.ORACLE[name])
    assert got == want


def test_every_query_runs(spark, sf):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE)):
        assert registry.QUERIES[name](spark, sf).count() >= 0
