"""Every registered query against its DuckDB oracle (the driver's gate),
at sf0.001 so the suite stays quick."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from tools.oracle_check import digest

ORACLE_NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_an_oracle():
    # real files, sinks and streams included: their results do not depend on
    # where the scratch data was written or how rows fell into batches
    from snapplan.catalog import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 200
    assert df.columns[:3] == ["path", "dir", "name"]
