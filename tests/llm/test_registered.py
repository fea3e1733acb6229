"""Registered corpus queries against their SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_entry import DIR, same  # noqa: E402

from keyloom.llm import queries  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered(spark, name):
    same(spark, name)
