"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest

from papyrine.plans import registry
from tests.oracle import expected, rows

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, smallest, name):
    got = registry.queries()[name](spark, smallest).toPandas()
    want = expected(smallest, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, smallest, name):
    df = registry.queries()[name](spark, smallest)
    assert df.columns
    df.count()


def test_flagship(spark, smallest):
    assert registry.flagship(spark, smallest).count() > 0
