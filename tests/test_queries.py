"""Every query with a SQL twin gives the twin's rows; the others run."""

import math

import pytest

from terrane import plans
from tests.oracle import both, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](plans.Tables(spark, FOLDER))
    if name in plans.SQL:
        ours, theirs = both(df, duck, plans.SQL[name])
        assert ours == theirs
    else:
        rows = df.collect()
        assert rows
        for k, c in enumerate(df.columns):
            values = [r[k] for r in rows if r[k] is not None]
            assert values, f"{c} is always null"
            assert all(math.isfinite(v) for v in values if isinstance(v, float)), f"{c} has values that are no numbers"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
