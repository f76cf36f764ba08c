"""Registered queries vs their DuckDB oracles on the smallest scale factor (value-exact)."""
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from oracle_check import _digest  # noqa: E402
from skydelay.plans.fixtures import RAW_TABLES  # noqa: E402

SLOW_OR_MODEL = ("I2_", "I3_", "I4_", "I5_", "I6_", "I7_", "I8_", "I10_", "I11_explain_rows", "I1_")
NAMES = [n for n in entry.oracle_sql() if not n.startswith(SLOW_OR_MODEL)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(c.lower() for c in sdf.columns) == sorted(c.lower() for c in d_cols)
    assert len(s_rows) == len(d_rows)
    assert _digest(sdf.columns, s_rows, False)[0] == _digest(d_cols, d_rows, False)[0]
