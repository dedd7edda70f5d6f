"""Every query of the catalog against its SQL."""

import pytest

from meshlark.plans import catalog

from oracle import connect, same

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        same(df, catalog.SQL[name], duck)
    else:
        assert df.count() >= 0
