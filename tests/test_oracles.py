"""Every registered query against its SQL, over the whole small tables."""

import pytest

from failscope import plans
from tests.conftest import SMALL
from tests.oracle import compare, connect

REGISTRY = plans.load()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, name):
    df = REGISTRY.QUERIES[name](spark, SMALL)
    if name in REGISTRY.ORACLES:
        assert compare(df, con, REGISTRY.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(REGISTRY.ORACLES) <= set(REGISTRY.QUERIES)
