"""Registered queries against their SQL twins in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from freshet.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = [FLAGSHIP, "p9_hllc_x", "r6_weno5", "w9_srm_source_2d", "b7_ghosts_mixed", "f12_green_ampt_drain", "t2_linear_lookup", "c5_cfl_percentile", "a7_rmse", "m2_neighbours", "d4_infill_nearest", "b9_inlets", "b12_ring_hybrid", "x3_euler_step"]


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_the_entry_module():
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    a, b = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a)
    sort = lambda d: d[cols].astype({c: "float64" for c in cols if d[c].dtype.kind in "iuf" or str(d[c].dtype) == "Int64"}).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(a), sort(b), check_exact=True)
