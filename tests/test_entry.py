"""The registered queries against their SQL at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from profilia.plans.oracles import ORACLES
from profilia.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def plain(x):
    if x is None or x != x:
        return None
    return str(x)[:10] if hasattr(x, "isoformat") else round(float(x), 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(k for k in ORACLES if k not in ("forecast_wide", "forecast_metrics", "monthly_rates", "cluster_mean_bands")))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted(names) == cols and got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["well_name", "t", "y_pred"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
