"""Every registered query against its SQL twin, or for a result where SQL has none."""

import pytest
from compare import differences
from conftest import SF

from voxsift import checks

QUERIES, ORACLE = checks.queries(), checks.oracle_sql()


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in ORACLE:
        assert differences(spark, SF, QUERIES[name], ORACLE[name]) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0
