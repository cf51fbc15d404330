"""Each query that SQL can express, whole table against DuckDB."""

import os

import pytest
from compare import compare, duck

from chalkline.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("CHALKLINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name]) is None
