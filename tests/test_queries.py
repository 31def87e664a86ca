"""Every named query of the library against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same

from tessella import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    rows = got.collect()
    assert len(got.columns) == len(set(got.columns))
    if name in SQL:
        left, right = same([tuple(r) for r in rows], got.columns, duck.execute(SQL[name]))
        assert left == right
    else:
        assert rows
