"""Every registered query of the reference's operators against its SQL."""

import pytest
from compare import same

from loomline.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    wanted = duck.sql(ORACLES[name]).df()
    assert len(wanted), "a query over the test tables has rows"
    same(QUERIES[name](spark, sf_dir), wanted)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
