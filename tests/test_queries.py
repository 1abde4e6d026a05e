"""Every query with SQL against DuckDB on the smallest tables, where they are there."""

from __future__ import annotations

import functools
import os

import duckdb
import pandas as pd
import pytest

from pigmenta import queries

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "customer", "supplier", "nation", "region"):
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(autouse=True, scope="module")
def stored_once():
    """Queries share the stored graphs here."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "_stored", functools.cache(queries._stored))
        patch.setattr(queries, "_dense", functools.cache(queries._dense))
        yield


#: Colours in distributed rounds that run here; ALL_QUERIES=1 runs every one.
ROUNDS = ("color_ldf", "color_sl_els_sdc_t10", "color_cpu_sll", "color_boundary_rr4", "color_rgp_rr4")
NAMES = [n for n in sorted(queries.SQL) if os.environ.get("ALL_QUERIES") or n in ROUNDS or not n.startswith("color_") or n.endswith("_local") or n in ("color_smallest_last", "color_dsatur")]


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    found, expected = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    found, expected = (x[columns].sort_values(columns).reset_index(drop=True) for x in (found, expected))
    pd.testing.assert_frame_equal(found, expected, check_dtype=False, rtol=1e-9)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
