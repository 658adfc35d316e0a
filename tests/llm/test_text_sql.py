import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402

from tickloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_duckdb(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) > 0
