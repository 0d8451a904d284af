from __future__ import annotations

import pytest

from clausewright.plans.queries import QUERIES
from clausewright.plans.sql import SQL
from conftest import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown_and_pruning(spark, data):
    plan = QUERIES["missing_embedding"](spark, data)._jdf.queryExecution().toString()
    assert "IsNull(chunk_embedding)" in plan
    assert "ReadSchema: struct<chunk_id:bigint,chunk_embedding:array<float>>" in plan
