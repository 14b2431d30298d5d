"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences, duck

from tapewright.plans import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert not differences(QUERIES[name](spark, SMALL), con, SQL[name])

