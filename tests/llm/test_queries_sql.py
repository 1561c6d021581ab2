"""Every registered text query runs over the smallest tables; those with SQL give the same rows."""

from __future__ import annotations

import os

import pytest

from corpuskiln.llm import queries as llm
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, con, name):
    df, sql = llm.queries()[name](spark, FOLDER), llm.oracle_sql().get(name)
    if sql:
        assert difference(df, sql, con) == ""
    else:
        assert df.count() > 0
