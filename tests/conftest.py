import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from docsieve.session import session

    s = session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_sql_adaptive_enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query and its SQL agree on a small folder."""
    import math

    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    def rows(df):
        df = df[sorted(df.columns)]
        return list(df.columns), sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)

    def check(query, sql):
        assert rows(query(spark, SF).toPandas()) == rows(duck.execute(sql).df())

    return check
