"""Every registered query with SQL against a second engine, on the smallest tables."""

import math
import os

import pytest

from costweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "customer documents events lineitem nation orders part region supplier".split()


def canonical(frame):
    out = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None):
        cells = []
        for v in row:
            missing = v is None or v != v
            cells.append("~" if missing else v.isoformat()[:10] if hasattr(v, "isoformat") else f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "dtype") or isinstance(v, int) and not isinstance(v, bool) else str(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.fixture(scope="module")
def second():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, second, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), second.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert rows and all(r.status == "ok" and math.isfinite(r.index_level) for r in rows)
