"""Every query of the engine that has a form in SQL, against DuckDB."""

import pytest

from hirelens.plans import records, screening  # noqa: F401
from tests.check_parity import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(screening.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, screening.QUERIES[name], screening.SQL[name], SF) is None
