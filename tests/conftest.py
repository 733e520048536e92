import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from snapplan.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    # plan shapes are those of tables too large to broadcast
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from snapplan.fixtures import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    return con
