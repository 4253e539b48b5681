"""Catalog queries against their SQL on the smallest folder."""

from pathlib import Path

import pytest

from colloquy.catalog import ORACLES, QUERIES
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
KEYS = sorted(ORACLES)

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_sql(spark, duck, key):
    assert compare(QUERIES[key](spark, FOLDER), duck, ORACLES[key]) is None
