"""Every query with a SQL twin, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def cells(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if isinstance(x, (list, dict)):
            return str(x)
        if pd.isna(x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or hasattr(x, "item"):
            x = float(x)
            return f"{x:.6g}" if math.isfinite(x) else str(x)
        return str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("p7")))
def test_query_equals_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_found_columns(spark):
    q = entry.queries()
    assert q["p2_found"](spark, SF).dtypes == [("set_id", "bigint"), ("pos", "bigint"), ("item", "string")]
    assert q["p4_found"](spark, SF).dtypes == [("src", "string"), ("record_id", "bigint"), ("node", "string"), ("mention_no", "bigint"), ("um", "bigint")]
    assert q["p5_found"](spark, SF).dtypes == [("src", "string"), ("record_id", "bigint"), ("parent_node", "string"), ("node", "string")]
    assert entry.entry(spark).limit(1).count() == 1
