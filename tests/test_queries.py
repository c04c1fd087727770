import importlib.util

import pytest

from millrace import catalog
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        compare(df, con, catalog.SQL[name])
    else:
        df.collect()


def test_entry(spark):
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
