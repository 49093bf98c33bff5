"""Every query with SQL against DuckDB on the smallest tables; every other one must run."""

import math

import duckdb
import pytest

from inkgauge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks candidates accepted_log edit_pairs briefs profiles holdout_items mix_targets".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _norm(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return None
        return round(float(v), 6) if isinstance(v, float) or "float" in type(v).__name__ else v.item() if hasattr(v, "item") else v

    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
