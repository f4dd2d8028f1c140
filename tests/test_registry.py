"""Every query of the library against its SQL; those without SQL run and have rows."""

import pytest

from docloom.plans import registry

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    if sql := registry.oracle_sql().get(name):
        got = duck.sql(sql)
        same_rows(rows, df.columns, got.fetchall(), got.columns)
    else:
        assert rows
