"""Each query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from doclathe.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
