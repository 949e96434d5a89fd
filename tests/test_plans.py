"""Every registered query of the engine against its SQL."""

import pytest

from lakeplan import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0
