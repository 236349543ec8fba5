"""Every registered query of the food and recipe operators against its SQL."""

import larder.plans  # noqa: F401
import pytest
from compare import duck_table, rows
from larder.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name not in ORACLES:
        assert got.num_rows >= 0
        return
    want = duck_table(duck, ORACLES[name])
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
