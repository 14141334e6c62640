import pytest

from quire.llm import registry
from tests.compare import both, views


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf, name):
    got, want = both(registry.QUERIES[name](spark, sf), views(sf), registry.ORACLE[name])
    assert got == want
