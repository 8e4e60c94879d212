import pytest

from quarrywork.plans import queries as core

from .oracle import same


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_matches_sql(spark, name):
    same(spark, core.QUERIES[name], core.ORACLES[name])
