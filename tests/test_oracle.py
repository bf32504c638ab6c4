"""Every query with an SQL twin, on the smallest table set."""

from __future__ import annotations

import os

import pytest

from oracle_check import compare, duck
from saleslode.catalogue import all_oracles, all_queries

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def database():
    return duck(FOLDER)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="table set not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert compare(QUERIES[name](spark, FOLDER), database, ORACLES[name]) == []
