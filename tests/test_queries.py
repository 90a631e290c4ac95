"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from vicinity.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    problems, _ = check.compare(spark, db, SF, name)
    assert not problems


def test_entry(spark):
    assert entry.entry(spark).count() > 0
