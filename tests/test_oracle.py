"""Every SQL-expressible query against its oracle on the sf0.01 tables."""

import os

import pytest

from tests.compare import DATA, compare, oracle_connection
from tidegrid.plans import ORACLES, QUERIES

SF_DIR = f"{DATA}/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
