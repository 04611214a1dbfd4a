import pytest
from comparing import assert_same, connect

from corvane.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    frame = QUERIES[name](spark, small)
    if name in ORACLE_SQL:
        assert_same(frame, con, ORACLE_SQL[name])
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
