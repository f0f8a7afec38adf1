import pytest

from touchline.plans import durable, pages  # noqa: F401  each adds its queries
from touchline.plans.registry import ORACLE_SQL, QUERIES

from oracle import connect, same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same_rows(df, ORACLE_SQL[name], con)
    else:
        assert df.count() > 0
