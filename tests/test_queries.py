"""Every registered query against its SQL, on the smallest data folder."""

import os

import pytest

from __spark_entry__ import ORACLES, QUERIES, entry
from check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).columns == ["project", "file_path", "n_items", "n_unresolved", "text"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(FOLDER), FOLDER, name)
    assert ok, note
