"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from fleetlens.plans import CATALOG

SMALL = "/root/testdata/sf0.001"
#: Queries of the training-data operators have their own tests.
QUERIES = CATALOG
ORACLE = {n: q.sql for n, q in CATALOG.items() if q.sql is not None}
#: On the smallest tables these find nothing, or SQL cannot say them.
NO_ORACLE = {n for n, q in CATALOG.items() if q.sql is None}
EMPTY_ON_SMALL = {"secrets_in_documents"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, QUERIES[name].run, ORACLE.get(name), SMALL)
    wanted = "rows-only" if name in NO_ORACLE else "EMPTY" if name in EMPTY_ON_SMALL else "ok"
    assert result.startswith(wanted), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
